"""Data-quality profiles: counts, distinct counts, column statistics, field counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Exact distinct count (two-level aggregate), or HyperLogLog++ when ``approx``."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(fn(col).alias("n"))


#: Registers of a distinct-count sketch: 2 ** 14, a standard error of 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, by: str, col: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(by, sketch): a HyperLogLog sketch of ``col`` per group, of bounded size; null is not counted.

    Distinct counts of months do not add up; their sketches do. A month's
    sketch is stored once and merged with others without reading rows again.
    """
    return df.groupBy(by).agg(F.hll_sketch_agg(col, F.lit(bits)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: str | None = None) -> DataFrame:
    """Estimated distinct count per ``by``, or of all sketches together."""
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    return sketches.agg(estimate) if by is None else sketches.groupBy(by).agg(estimate)


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: count, mean, population stdev, max, min over the non-missing
    values, and the number of missing (null or NaN) values.

    One aggregate for all columns (partial + final), unpivoted to one row per column.
    """
    aggs = []
    for c in cols:
        ok = f"case when not isnan(`{c}`) then `{c}` end"
        aggs += [F.expr(f"count({ok}) as `{c}__n`"),
                 F.expr(f"avg({ok}) as `{c}__mean`"),
                 F.expr(f"stddev_pop({ok}) as `{c}__stdev`"),
                 F.expr(f"max({ok}) as `{c}__max`"), F.expr(f"min({ok}) as `{c}__min`"),
                 F.expr(f"count_if(`{c}` is null or isnan(`{c}`)) as `{c}__nan`")]
    one = df.agg(*aggs)
    fields = ("n", "mean", "stdev", "max", "min", "nan")
    body = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{f}`" for f in fields) for c in cols)
    return one.selectExpr(f"stack({len(cols)}, {body}) as (`column`, {', '.join(fields)})")


def token_count(line: Column, sep: str) -> Column:
    """Number of fields when ``line`` is split on the literal ``sep``, keeping empty ones."""
    return F.size(F.split(line, "\\Q" + sep + "\\E", -1))


def field_count_profile(lines: DataFrame, line_col: str, seps: Sequence[str]) -> DataFrame:
    """Field-count statistics of ``line_col`` for each candidate separator.

    A right separator gives the same count on every line (stdev 0).
    """
    counts = lines.select(*[token_count(F.col(line_col), s).cast("double").alias(f"s{i}")
                            for i, s in enumerate(seps)])
    prof = column_profile(counts, [f"s{i}" for i in range(len(seps))])
    names = " ".join(f"when 's{i}' then '{s.replace(chr(39), chr(39) * 2)}'"
                     for i, s in enumerate(seps))
    return prof.selectExpr(f"case `column` {names} end as sep", "n", "mean", "stdev", "max",
                           "min", "nan")
