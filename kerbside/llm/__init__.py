"""Operators for preparing large text collections for training."""
