"""Scans of CSV, JSON and Parquet."""
