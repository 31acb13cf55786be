"""Device pipeline: who changed handset, labelled history, forest scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import SKIPPED_PERIODS
from ..operators import change
from ..session import materialize
from ..sources.tables import read_table
from . import fixtures


class DeviceInputs:
    """The derived device frames for one data directory.

    With ``reuse=True`` the per-(user, period) snapshot is computed once and
    written with a reliable ``checkpoint`` to the shared checkpoint folder:
    queries that read it several times (change set, labels, scoring) then
    scan ``events`` once, not once per use, and a lost executor does not
    replay the event aggregation. Building such a frame runs a job; the
    checkpoint goes when the session's cleaner finds it unused
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).

    ``periods`` (first, last) reads the events of those periods only.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, reuse: bool = False,
                 periods: tuple[int, int] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.periods = periods
        events = read_table(spark, sf_dir, "events")
        self.events = events if periods is None else fixtures.in_periods(events, *periods)
        self.reuse = reuse
        self._snap: DataFrame | None = None

    @property
    def snap(self) -> DataFrame:
        if self._snap is None:
            snap = fixtures.device_snapshot(self.events)
            if self.reuse:
                snap = materialize(snap)
            self._snap = snap
        return self._snap

    @property
    def targets(self) -> DataFrame:
        return fixtures.target_list(read_table(self.spark, self.sf_dir, "supplier"))

    @property
    def switch(self) -> DataFrame:
        """Changes; with ``periods``, of all but the first of them, which only gives the values before."""
        found = change.changed_between_periods(self.snap, self.targets, skip=SKIPPED_PERIODS)
        return found if self.periods is None else found.where(found["period"] > self.periods[0])

    @property
    def labeled(self) -> DataFrame:
        wanted = None if self.periods is None else [
            p for p in range(self.periods[0] + 1, self.periods[1] + 1) if p not in SKIPPED_PERIODS]
        return change.label_previous_period(self.snap, self.targets, self.switch,
                                            skip=SKIPPED_PERIODS, periods=wanted)
