"""Period-over-period change detection and labelling (device pipeline).

The original ran one SQL query per month, each with two left joins, and a
second set of per-month queries for labels, unioned afterwards. Here a period
is a column: every operator is a single query over all periods.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEVICE_BEHAVIOUR, SKIPPED_PERIODS
from .prune import keep_keys


def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str],
                   keep_order: bool = False, max_codes: int = 256) -> DataFrame:
    """One row per ``keys``: the ``cols`` of the row with the largest ``order_col``.

    A group-by with ``max_by`` rather than a ``row_number`` window, so each
    map task reduces its rows before the shuffle: a key holding a third of
    all rows costs one partial row per task, not one huge window partition.

    Spark hash-aggregates only values of fixed width. A text column with at
    most ``max_codes`` distinct values is therefore replaced by their
    positions in that list, which become literals, and decoded after the
    aggregate; with more values the column stays as it is, and the same
    result comes from a sort-based aggregate. ``order_col`` must be unique
    within a key; ``keep_order`` returns it as well.
    """
    coded: dict[str, list[str]] = {}
    for c in cols:
        if dict(df.dtypes)[c] == "string":
            found = df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_codes + 1).collect()
            if len(found) <= max_codes:
                coded[c] = sorted(r[0] for r in found)
    picks = []
    for c in cols:
        value = F.array_position(F.lit(coded[c]), F.col(c)).cast("int") if coded.get(c) else F.col(c)
        picks.append(F.max_by(value, F.col(order_col)).alias(c))
    if keep_order:
        picks.append(F.max(order_col).alias(order_col))
    out = df.groupBy(*keys).agg(*picks)
    decoded = {c: F.element_at(F.lit(names), F.col(c)) for c, names in coded.items() if names}
    return out.withColumns(decoded) if decoded else out


def changed_between_periods(snap: DataFrame, targets: DataFrame, key: str = "user_id",
                            period: str = "period",
                            attrs: Mapping[str, str] | None = None,
                            mode: str = "all",
                            skip: Sequence[int] = SKIPPED_PERIODS) -> DataFrame:
    """Targets whose attributes changed from period p-1 to p.

    ``snap`` has one row per (key, period). ``attrs`` maps a snapshot column
    to the suffix of its output pair ``n_<suffix>`` (this period) and
    ``b_<suffix>`` (period before). ``mode='all'`` needs every attribute to
    differ, ``'any'`` one of them. A missing previous period is never a
    change; a null attribute compares as unknown (SQL three-valued logic), so
    in ``'all'`` mode it blocks a change and in ``'any'`` mode another
    differing attribute still makes one. Periods in ``skip`` are never reported.

    One pass: keep targets (``keep_keys``, before the shuffle), then ``lag``
    over each key's own periods. The window is partitioned by key and a key has at most one row
    per period, so no window partition grows with the data.
    """
    attrs = dict(attrs or {"vendor": "vendor", "dtype": "type"})
    w = Window.partitionBy(key).orderBy(period)
    cur = keep_keys(snap, targets, key)
    prev_period = F.lag(period).over(w)
    lagged = cur.select(
        period, key,
        *[F.col(c).alias(f"n_{s}") for c, s in attrs.items()],
        *[F.when(prev_period == F.col(period) - 1, F.lag(c).over(w)).alias(f"b_{s}")
          for c, s in attrs.items()])
    diffs = [F.col(f"n_{s}") != F.col(f"b_{s}") for s in attrs.values()]
    cond = diffs[0]
    for d in diffs[1:]:
        cond = (cond & d) if mode == "all" else (cond | d)
    return lagged.where(cond & ~F.col(period).isin(list(skip)))


def periods_with_changes(snap: DataFrame, period: str = "period",
                         skip: Sequence[int] = SKIPPED_PERIODS):
    """Sorted array of the snapshot's periods, less ``skip``, as a scalar subquery.

    The set is bounded by the number of periods, so it is one small value
    that Spark computes once and inlines, not a join input.
    """
    return (snap.where(~F.col(period).isin(list(skip)))
                .select(F.sort_array(F.collect_set(period))).scalar())


def label_rows(snap: DataFrame, targets: DataFrame, changes: DataFrame, key: str = "user_id", period: str = "period",
               behaviour: Sequence[str] = DEVICE_BEHAVIOUR, skip: Sequence[int] = SKIPPED_PERIODS,
               periods: Sequence[int] | None = None, **limits) -> DataFrame:
    """The rows that the labels are folded from, before their one shuffle.

    The target x period grid, the targets' snapshot shifted by one period,
    and the change rows: at most three rows per target and period, whatever
    the number of other subscribers (a bitmap for very long target lists lets
    a few of them through; the fold drops them).
    """
    wanted = periods_with_changes(snap, period, skip) if periods is None else F.lit(list(periods))
    grid = targets.select(key, F.explode(wanted).alias(period))
    record = T.StructType([T.StructField(c, snap.schema[c].dataType) for c in behaviour])
    none = F.lit(None).cast(record)
    own = keep_keys(snap.select(key, period, *behaviour), targets, key, exact=False, **limits)
    return (grid.select(key, period, F.lit(1).alias("_grid"), none.alias("_prev"), F.lit(0).alias("_hit"))
            .unionByName(own.select(key, (F.col(period) + 1).alias(period), F.lit(0).alias("_grid"),
                                    F.struct(*behaviour).cast(record).alias("_prev"),
                                    F.lit(0).alias("_hit")))
            .unionByName(changes.select(key, period, F.lit(0).alias("_grid"), none.alias("_prev"),
                                        F.lit(1).alias("_hit"))))


def label_previous_period(snap: DataFrame, targets: DataFrame, changes: DataFrame,
                          key: str = "user_id", period: str = "period",
                          behaviour: Sequence[str] = DEVICE_BEHAVIOUR,
                          skip: Sequence[int] = SKIPPED_PERIODS,
                          periods: Sequence[int] | None = None, **limits) -> DataFrame:
    """Every target in every labelled period p: its behaviour in p-1 and a 0/1 label.

    label = 1 when the target is in ``changes`` for p; the output has exactly
    |targets| x |periods| rows (targets are a set of keys, without null). The
    period grid is ``explode`` of a scalar subquery, not a cross join;
    ``periods`` gives it instead, for a snapshot that holds some periods only.

    The rows of ``label_rows`` are folded by one group-by on (key, period): a
    single shuffle of target rows only, no sort-merge joins. ``limits`` go to
    ``keep_keys``.
    """
    rows = label_rows(snap, targets, changes, key, period, behaviour, skip, periods, **limits)
    # At most one previous-period record per (key, period), so first() is exact.
    folded = rows.groupBy(key, period).agg(F.max("_grid").alias("_grid"),
                                           F.first("_prev", ignorenulls=True).alias("_prev"),
                                           F.max("_hit").alias("label"))
    return folded.where(F.col("_grid") == 1).select(
        period, key, *[F.col(f"_prev.{c}").alias(c) for c in behaviour], "label")


def rows_in_period(snap: DataFrame, targets: DataFrame, value: int,
                   key: str = "user_id", period: str = "period") -> DataFrame:
    """The targets' snapshot rows of one period (targets are a set of keys)."""
    return keep_keys(snap.where(F.col(period) == value), targets, key)


def counts_per_period(df: DataFrame, period: str = "period") -> DataFrame:
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
