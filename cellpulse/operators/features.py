"""Category indexing and feature rows for the forest.

The original collected each column's distinct values to the driver and
keyed them by Java ``hashCode`` (equal hashes would merge categories, and
the index depended on collect order). Here a category's index is its rank
among the sorted distinct values of its column, computed and joined on the
cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEVICE_CATEGORICAL, DEVICE_NUMERIC
from ..session import bounded_broadcast, materialize

#: What a missing number becomes in a feature row; no counter is negative.
MISSING = -1


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value): the distinct values of each column, in one pass; null is a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").distinct()


def category_index(df: DataFrame, cols: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(column, value, idx): 0-based rank of each distinct non-null value within its column.

    With ``known`` (column, value), only the values that it lacks are ranked.

    Distributed, with no single-task step over the values: the distinct
    values of all columns are range-partitioned and sorted (``orderBy``),
    numbered with ``monotonically_increasing_id`` (partition id in the high
    bits, position in the low 33 bits) and materialised so every reader sees
    the same numbering. A value's place is the number of values in earlier
    partitions (a running sum over one row per partition, a bounded table)
    plus its position in its own partition; its rank is its place less the
    first place of its column.
    """
    values = distinct_values(df, cols).where(F.col("value").isNotNull())
    if known is not None:
        values = values.join(known.select("column", "value"), ["column", "value"], "left_anti")
    numbered = materialize(values.orderBy("column", "value").select(
        "column", "value", F.monotonically_increasing_id().alias("_id")))
    numbered = numbered.select("column", "value", F.shiftright("_id", 33).alias("_part"),
                               F.col("_id").bitwiseAND((1 << 33) - 1).alias("_pos"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
                       .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0))
                               .alias("_offset")))
    # One row per partition of the sorted values, one per column.
    placed = (numbered.join(bounded_broadcast(offsets, known_bytes=64 * max(numbered.rdd.getNumPartitions(), 1)), "_part")
                      .select("column", "value", (F.col("_offset") + F.col("_pos")).alias("_place")))
    first = placed.groupBy("column").agg(F.min("_place").alias("_first"))
    return (placed.join(bounded_broadcast(first, known_bytes=64 * len(cols)), "column")
                  .select("column", "value", (F.col("_place") - F.col("_first")).cast("int").alias("idx")))


def with_category_index(df: DataFrame, cols: Sequence[str], index: DataFrame) -> DataFrame:
    """Adds ``<col>_idx`` per categorical column; null or a value outside ``index`` gets the next index.

    ``index`` (of ``category_index``) is built from the whole device log, so
    an index does not depend on which rows were selected. It is computed
    once by the caller (a table or a checkpoint), and a column's part is
    broadcast after a check of its bytes: the rows are not shuffled on a
    category of a few values. Beyond the bound the join is left to Spark.
    """
    sizes = {c: n - 1 for c, n in arities(index, cols).items()}
    out = df
    for c in cols:
        part = index.where(F.col("column") == c).select(F.col("value").alias(f"_{c}"), F.col("idx").alias(f"{c}_idx"))
        out = out.join(bounded_broadcast(part), out[c].cast("string") == part[f"_{c}"], "left").drop(f"_{c}")
        out = out.withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(sizes.get(c, 0))))
    return out


def feature_rows(rows: DataFrame, index: DataFrame, categorical: Sequence[str] = DEVICE_CATEGORICAL,
                 numeric: Sequence[str] = DEVICE_NUMERIC,
                 keep: Sequence[str] = ("period", "user_id", "label")) -> DataFrame:
    """One feature row per row: an index per category and the numbers, none of them null.

    A target without a record in the previous period keeps its row: its
    categories are *unknown* (the index after the last) and its numbers
    ``MISSING``.
    """
    indexed = with_category_index(rows, categorical, index)
    return indexed.select(*keep, *[f"{c}_idx" for c in categorical],
                          *[F.coalesce(c, F.lit(MISSING)).alias(c) for c in numeric])


def arities(index: DataFrame, categorical: Sequence[str] = DEVICE_CATEGORICAL) -> dict[str, int]:
    """Number of indices of each category, *unknown* included."""
    sizes = {r["column"]: r["n"] for r in index.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: sizes.get(c, 0) + 1 for c in categorical}
