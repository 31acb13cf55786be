"""Usage-profile operators: sum per key, L2 normalisation, histogram thresholds, tags.

Per-feature statistics (min, max, bucket counts) are single-row aggregates
over the whole frame. They reach the row-wise expressions as one scalar
subquery bound as a struct column, which Spark runs once and inlines: no
cross join, no driver round trip and no single-partition window.

The per-column expressions are SQL text (``F.expr`` / ``selectExpr``): one
call per expression instead of one per operator keeps plan building cheap
for 20-column profiles; the plan is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def q(name: str) -> str:
    """Backtick-quoted identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sum_by_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Group-by sum of ``cols`` per ``key``, columns keep their names (partial + final aggregate)."""
    return df.groupBy(key).agg(*[F.expr(f"sum({q(c)}) as {q(c)}") for c in cols])


def l2_norm_sql(cols: Sequence[str]) -> str:
    """sqrt(c1*c1 + c2*c2 + ...), summed left to right."""
    return "sqrt(" + " + ".join(f"{q(c)} * {q(c)}" for c in cols) + ")"


def l2_normalize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Divide ``cols`` by their row's L2 norm; an all-zero row stays as it is."""
    wanted = set(cols)
    with_norm = df.selectExpr("*", f"{l2_norm_sql(cols)} as __norm")
    return with_norm.selectExpr(*[
        f"case when __norm = 0 then {q(c)} else {q(c)} / __norm end as {q(c)}"
        if c in wanted else q(c) for c in df.columns])


def edge_sql(mn: str, mx: str, index, buckets: int) -> str:
    """Left edge of bucket ``index`` of ``buckets`` equal-width buckets: min + i*(max-min)/b."""
    return f"{mn} + cast({index} as double) * ({mx} - {mn}) / {float(buckets)!r}D"


def thresholds(df: DataFrame, cols: Sequence[str], buckets: int = 5) -> DataFrame:
    """One row ``t_<c>``: the left edge of the last histogram bucket of each column.

    A constant column (max = min) gets its value, so nothing exceeds it.
    """
    return df.agg(*[F.expr(edge_sql(f"min({q(c)})", f"max({q(c)})", buckets - 1, buckets)
                           + f" as {q('t_' + c)}") for c in cols])


def flag_above(df: DataFrame, cols: Sequence[str], thr: DataFrame,
               keep: Sequence[str] = ()) -> DataFrame:
    """``c`` -> 1 when the value is strictly above ``thr.t_<c>``, else 0 (int).

    The threshold row is bound once as a struct column, so the plan holds one
    scalar subquery however many columns read it.
    """
    limits = thr.select(F.struct(*[f"t_{c}" for c in cols]).alias("t")).scalar()
    bound = df.withColumn("__t", limits)
    return bound.selectExpr(*[q(k) for k in keep], *[
        f"case when {q(c)} > __t.{q('t_' + c)} then 1 else 0 end as {q(c)}" for c in cols])


def bucket_sql(x: str, mn: str, mx: str, buckets: int) -> str:
    """Equal-width bucket of ``x`` in [mn, mx]; the top edge closes the last bucket.

    (x - min) / (max - min) * buckets, truncated; a constant column is bucket 0.
    """
    raw = f"cast(floor(({x} - {mn}) / ({mx} - {mn}) * {float(buckets)!r}D) as int)"
    return f"case when {mx} = {mn} then 0 else least({raw}, {buckets - 1}) end"


def histogram(df: DataFrame, cols: Sequence[str], buckets: int = 5) -> DataFrame:
    """Long histogram (feature, bucket, lo, n) with every bucket, empty ones too.

    Two single-row aggregates: min/max of every column (one scalar subquery,
    bound once as a struct column), then all ``len(cols) * buckets`` counts in
    one pass; the one result row is unpivoted.
    """
    stats = df.select(F.struct(*[F.expr(f"min({q(c)}) as mn_{i}") for i, c in enumerate(cols)],
                               *[F.expr(f"max({q(c)}) as mx_{i}") for i, c in enumerate(cols)])
                      .alias("s")).scalar()
    bound = df.select(*[q(c) for c in cols], stats.alias("__s"))
    counts = []
    for i, c in enumerate(cols):
        b = bucket_sql(q(c), f"__s.mn_{i}", f"__s.mx_{i}", buckets)
        counts += [F.expr(f"count_if({b} = {j}) as n_{i}_{j}") for j in range(buckets)]
    one = bound.agg(F.expr("any_value(__s) as __s"), *counts)
    rows = ", ".join(f"'{c}', {j}, {edge_sql(f'__s.mn_{i}', f'__s.mx_{i}', j, buckets)}, n_{i}_{j}"
                     for i, c in enumerate(cols) for j in range(buckets))
    return one.selectExpr(f"stack({len(cols) * buckets}, {rows}) as (feature, bucket, lo, n)")
