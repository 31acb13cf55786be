"""Record shapes of the three analyses, derived from the ``events`` table.

The original inputs (monthly device logs, usage profiles, hourly locations)
are not public, so each is derived from ``events`` by a fixed rule. All
derivations are plain DataFrame code and grow with ``events``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEVICE_FIELDS, PROFILE_COLUMNS
from ..operators.change import latest_per_key

N_PERIODS = 12
DAYS = 30
START = dt.datetime(2024, 1, 1)   # first day of period 1
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BANDS = 4  # six-hour bands of the day


def with_period(events: DataFrame) -> DataFrame:
    """A running period number: spans of 2.5 days since ``START`` (12 spans in its first 30 days).

    Days after the twelfth span go on with 13, days before the first with 0:
    no two dates far apart share a period.
    """
    day = F.date_diff(F.to_date("ts"), F.lit(START.date()))
    return events.withColumn("period", (F.floor(day * N_PERIODS / DAYS) + 1).cast("int"))


def in_periods(events: DataFrame, first: int, last: int) -> DataFrame:
    """Events of some consecutive periods, as a range of ``ts`` that the Parquet scan can use."""
    def start(period: int) -> Column:
        days = -(-(period - 1) * DAYS // N_PERIODS)  # first whole day of the period
        return F.lit((START + dt.timedelta(days=days)).isoformat()).cast("timestamp_ntz")

    return events.where((F.col("ts") >= start(first)) & (F.col("ts") < start(last + 1)))


def band(index: Column, width: int) -> Column:
    """Name of an equal-width band, e.g. ``30-39``."""
    low = index.cast("int") * width
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def device_snapshot(events: DataFrame) -> DataFrame:
    """One device record per (user, period): the period's last event.

    vendor = event type; dtype (model) = M and value / 100; voice =
    value; sms = id mod 100; net = 2G or 3G by the id's parity; gender of
    three by id mod 3; age of nine ten-year bands by user mod 9; arpu of eight bands of 50
    by value; bytes of twelve bands of 500 by id mod 12.
    """
    rows = with_period(events).select("user_id", "period", "event_id", F.col("event_type").alias("vendor"),
                                      F.floor("value").cast("int").alias("voice"))
    last = latest_per_key(rows, ["user_id", "period"], "event_id", ["vendor", "voice"], keep_order=True)
    number = F.col("event_id")
    return last.select("user_id", "period", "vendor", "voice", number.alias("_id")).withColumns({
        "net": F.when(F.col("_id") % 2 == 0, "2G").otherwise("3G"),
        "gender": F.when(F.col("_id") % 3 == 0, "F").when(F.col("_id") % 3 == 1, "M").otherwise("U"),
        "age": band(F.col("user_id") % 9, 10),
        "arpu": band(F.floor(F.col("voice") / 50) % 8, 50),
        "dtype": F.concat(F.lit("M"), F.floor(F.col("voice") / 100).cast("string")),
        "bytes": band(F.col("_id") % 12, 500),
        "sms": (F.col("_id") % 100).cast("int"),
    }).select(*DEVICE_FIELDS)


def target_list(suppliers: DataFrame) -> DataFrame:
    """The subscribers to score: twice each supplier key.

    A list of its own, not taken from the log: some of its ids have no
    record, and half of the log's users are not on it. Keys are unique.
    """
    return suppliers.select((F.col("s_suppkey") * 2).cast("long").alias("user_id"))


def usage_rows(events: DataFrame, keep=()) -> DataFrame:
    """Raw usage rows: one per event, its whole value in one of 20 counters.

    Counter = event type (5) x six-hour band (4), in the order of
    ``EVENT_TYPES`` then band; several rows per user, like the raw profile.
    """
    counters = []
    for i, name in enumerate(PROFILE_COLUMNS):
        etype, b = EVENT_TYPES[i // BANDS], i % BANDS
        counters.append(f"case when event_type = '{etype}' and floor(hour(ts) / 6) = {b} "
                        f"then cast(floor(value) as double) else 0D end as {name}")
    return events.selectExpr("user_id", *keep, *counters)


def _coords_sql(top: str) -> tuple[str, str]:
    """The fixed rule from an hour's largest event id to an (x, y) point."""
    return f"121.4D + ({top} % 170) / 1000.0D", f"31.17D + ({top} % 131) / 1000.0D"


def usage_lines(events: DataFrame) -> DataFrame:
    """Raw usage rows as 24 text fields: quoted, blanks for zeros, and a header row by content.

    Positions 6, 7 and 22 hold fields that the analysis drops.
    """
    raw = usage_rows(events, keep=["event_id", "value"])
    extra = {6: "cast(event_id % 2 as string)",
             7: "case when event_id % 3 = 0 then '1' else '' end",
             22: "cast(value as string)"}
    counters = iter(PROFILE_COLUMNS)
    cols = ["""concat('"', cast(user_id as string), '"') as _c0"""]
    for i in range(1, 24):
        cols.append(f"{extra[i]} as _c{i}" if i in extra
                    else f"""concat('"', cast(nullif({next(counters)}, 0D) as string), '"') as _c{i}""")
    header = events.sparkSession.range(1).select(*[F.lit("IMEI" if i == 0 else f"h{i}").alias(f"_c{i}") for i in range(24)])
    return header.unionByName(raw.selectExpr(*cols))


def wide_locations(events: DataFrame, hours: int = 24) -> DataFrame:
    """Wide rows (user, date, x0, y0 .. x23, y23; 0 = no point) straight from events.

    Coordinates come from the hour's largest event id, so they are
    deterministic and spread over and beyond the area boxes. One aggregation:
    the largest id of each hour is a conditional max, so map tasks combine
    before the single shuffle on (user, date).
    """
    tops = [F.expr(f"max(case when hour(ts) = {h} then event_id end) as _t{h}")
            for h in range(hours)]
    agg = events.groupBy("user_id", F.to_date("ts").alias("dt")).agg(*tops)
    cols = []
    for h in range(hours):
        x, y = _coords_sql(f"_t{h}")
        cols += [f"coalesce({x}, 0D) as x{h}", f"coalesce({y}, 0D) as y{h}"]
    return agg.selectExpr("user_id", "dt", *cols)
