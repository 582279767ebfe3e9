"""Kerbside regulation engine: parking-sign and paid-spot analytics as Spark DataFrames."""
