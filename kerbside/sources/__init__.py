"""Readers and writers: delimited text, Parquet, GeoJSON."""
