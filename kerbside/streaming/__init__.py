"""Queries over streams of moments."""
