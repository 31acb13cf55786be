"""Readers and writers: the parquet tables, and the CSV formats of the three analyses."""
