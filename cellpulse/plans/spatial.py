"""Spatial pipeline: hourly points -> wide rows -> long rows -> area -> nearest centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AREA_BOXES, CLUSTER_CENTRES
from ..operators import spatial as op
from ..sources.tables import read_table
from . import fixtures

KEYS = ["user_id", "dt"]


class SpatialInputs:
    """Derived location frames for one data directory.

    ``hour`` keeps only that hour of the day. A located record's hour is
    ``hour(ts)`` of the events it comes from, so filtering the events gives
    exactly the rows a later ``hr == hour`` filter would keep; Catalyst
    cannot push that filter through the unpivot generator itself, so a
    one-hour report asks for it here and aggregates 1/24 of the events.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, hour: int | None = None):
        self.spark = spark
        events = read_table(spark, sf_dir, "events")
        self.events = events if hour is None else events.where(F.hour("ts") == hour)

    @property
    def wide(self) -> DataFrame:
        """The wide hourly rows (one shuffle)."""
        return fixtures.wide_locations(self.events)

    @property
    def long(self) -> DataFrame:
        return op.unpivot_hours(self.wide, KEYS)

    @property
    def areas(self) -> DataFrame:
        return op.area_table(self.spark)

    @property
    def centres(self) -> DataFrame:
        return op.centre_table(self.spark)

    @property
    def area(self) -> DataFrame:
        # Fixed boxes: a bound on their cells and the cell side are known without a job.
        side = max(max(x1 - x0, y1 - y0) for _, x0, x1, y0, y1 in AREA_BOXES)
        return op.assign_area(self.long, self.areas, cell=side / 4, known_bytes=len(AREA_BOXES) * 25 * 128)

    @property
    def clus(self) -> DataFrame:
        return op.nearest_centre(self.area, self.centres,
                                 known_bytes=64 * sum(len(c) for c in CLUSTER_CENTRES.values()))
