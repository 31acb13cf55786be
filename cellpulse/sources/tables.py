"""Readers for the parquet tables the analyses start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Parquet gives pruning and pushdown."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
