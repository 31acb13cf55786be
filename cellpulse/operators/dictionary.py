"""A dictionary of categories that outlives a run.

An index that is a rank shifts when a value is added, so a saved model could
not read next month's rows. Here a value keeps the index it was given:
new values of a column come after all that are known, in their own order, and
each growth is a version. A model names the version it was trained on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize
from ..sources.folders import Published
from .features import category_index

SCHEMA = "column string, value string, idx int, version int"


def additions(known: DataFrame, rows: DataFrame, cols: Sequence[str], version: int) -> DataFrame:
    """(column, value, idx, version) of the values of ``rows`` that ``known`` lacks.

    Their index is their rank among themselves after the last known index of
    the column. Null is no value. The known values are joined, not collected.
    """
    ranked = category_index(rows, cols, known=known)
    # One row per column.
    ends = known.groupBy("column").agg((F.max("idx") + 1).alias("_end"))
    return (ranked.join(bounded_broadcast(ends, known_bytes=64 * len(cols)), "column", "left")
            .select("column", "value", (F.col("idx") + F.coalesce("_end", F.lit(0))).cast("int").alias("idx"),
                    F.lit(version).alias("version")))


class CategoryDictionary:
    """The dictionary at ``root``: a folder per version with all its values.

    A version that a failed job left half written is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.states = spark, Published(spark, root)

    @property
    def version(self) -> int:
        """The last whole version; 0 before the first."""
        return (self.states.versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """(column, value, idx, version) as it was at ``version`` (default: the last)."""
        wanted = self.version if version is None else version
        if wanted == 0:
            return self.spark.createDataFrame([], SCHEMA)
        return self.states.read(wanted).select("column", "value", "idx", "version")

    def grow(self, rows: DataFrame, cols: Sequence[str]) -> int:
        """Add what is new in ``rows``; returns the version that holds all of its values.

        Nothing new, no new version. Numbers of versions rise but may have gaps.
        """
        known = self.read()
        fresh = materialize(additions(known, rows, cols, self.version + 1))
        if not fresh.take(1):
            return self.version
        before, more = known.count(), fresh.count()

        def all_there(path: str) -> None:
            found = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.count_distinct("column", "idx")).first()
            if tuple(found) != (before + more, before + more):
                raise ValueError(f"dictionary would hold {found[0]} values and {found[1]} indices, not {before + more}")

        return self.states.publish(known.unionByName(fresh).write.parquet, check=all_there)
