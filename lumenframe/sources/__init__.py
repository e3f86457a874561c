"""Readers and writers: CSV, JSON, Parquet and Delta tables."""
