"""Device months kept one by one: a new month is added without touching the old ones.

Each month's snapshot is a folder of its own, bucketed and sorted by user, so
that two months meet bucket by bucket. The change set and the labels of a new
month read that month and the one before, whatever the length of the history.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEVICE_BEHAVIOUR, SKIPPED_PERIODS
from ..operators.change import label_previous_period
from ..operators.prune import keep_keys
from ..session import scratch_path
from ..sources.folders import children, is_whole, move, read_note, remove, write_note


class MonthStore:
    """Monthly snapshots below ``root``, one row per user and month.

    The number of buckets is fixed when the store is made: about one per
    256 MB of a month. A month is there whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, key: str = "user_id", period: str = "period"):
        self.spark, self.root, self.key, self.period = spark, root.rstrip("/"), key, period
        if is_whole(spark, f"{self.root}/note"):
            note = read_note(spark, f"{self.root}/note")
            self.buckets, self.schema = note["buckets"], note["schema"]
        else:
            self.buckets, self.schema = buckets, None

    def _path(self, month: int) -> str:
        return f"{self.root}/month={month}"

    def months(self) -> list[int]:
        """Months that are there whole, rising."""
        found = [int(c[6:]) for c in children(self.spark, self.root) if c.startswith("month=")]
        return sorted(m for m in found if is_whole(self.spark, self._path(m)))

    def append(self, month: int, rows: DataFrame) -> None:
        """Add or replace one month; ``rows`` are its snapshot, in the columns of the others."""
        schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        if self.schema is None:
            write_note(self.spark, f"{self.root}/note", {"buckets": self.buckets, "schema": schema})
            self.schema = schema
        if schema != self.schema:
            raise ValueError(f"columns {schema} are not those of the store: {self.schema}")
        path, name = scratch_path(self.spark, "month"), f"cellpulse_month_{uuid.uuid4().hex}"
        # Dealt like the buckets, so each is one file.
        (rows.repartition(self.buckets, self.key).write.format("parquet").bucketBy(self.buckets, self.key)
             .sortBy(self.key).option("path", path).saveAsTable(name))
        self.spark.sql(f"drop table {name}")  # the name only: the files are its own
        remove(self.spark, self._path(month))
        move(self.spark, path, self._path(month))

    def read(self, month: int) -> DataFrame:
        """One month, known to Spark as dealt out by user."""
        if not is_whole(self.spark, self._path(month)):
            raise FileNotFoundError(f"month {month} is not in {self.root}")
        name = f"cellpulse_month_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({self.schema}) using parquet clustered by ({self.key}) "
                       f"sorted by ({self.key}) into {self.buckets} buckets location '{self._path(month)}'")
        rows = self.spark.table(name)
        rows.schema  # resolved: the name is not needed any more
        self.spark.sql(f"drop table {name}")
        return rows

    def changes_of(self, month: int, targets: DataFrame, attrs: Mapping[str, str] | None = None,
                   skip: Sequence[int] = SKIPPED_PERIODS) -> DataFrame:
        """Targets whose attributes all changed from the month before, as ``changed_between_periods`` gives them.

        Joined bucket by bucket: neither month is shuffled. A month that is
        skipped, or has no month before it in the store, has no changes.
        """
        attrs = dict(attrs or {"vendor": "vendor", "dtype": "type"})
        now = self.read(month)
        known = month - 1 in self.months() and month not in set(skip)
        old = self.read(month - 1) if known else now.where(F.lit(False))
        old = old.select(self.key, *[F.col(c).alias(f"b_{s}") for c, s in attrs.items()])
        pairs = keep_keys(now, targets, self.key).join(old, self.key)
        for c, s in attrs.items():
            pairs = pairs.where(F.col(c) != F.col(f"b_{s}"))
        return pairs.select(self.period, self.key, *[F.col(c).alias(f"n_{s}") for c, s in attrs.items()],
                            *[f"b_{s}" for s in attrs.values()])

    def labels_of(self, month: int, targets: DataFrame, behaviour: Sequence[str] = DEVICE_BEHAVIOUR,
                  skip: Sequence[int] = SKIPPED_PERIODS) -> DataFrame:
        """The month's label and the behaviour in the month before, per target; only target rows are shuffled."""
        old = self.read(month - 1) if month - 1 in self.months() else self.read(month).where(F.lit(False))
        wanted = [] if month in set(skip) else [month]
        return label_previous_period(old, targets, self.changes_of(month, targets, skip=skip), self.key, self.period,
                                     behaviour, skip, periods=wanted)
