"""Profile pipeline: raw usage rows -> per-user sums -> L2 norm -> thresholds -> 0/1 tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import PROFILE_COLUMNS
from ..operators import profile as op
from ..session import materialize
from ..sources.tables import read_table
from . import fixtures


class ProfileInputs:
    """Derived profile frames for one data directory.

    With ``reuse=True`` the summed profile (one row per user) is materialised
    once in the shared checkpoint folder, so the sums, the threshold subquery
    and the flags read it instead of aggregating ``events`` each on its own;
    normalising is row by row and is done again by each reader.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, reuse: bool = False):
        self.events = read_table(spark, sf_dir, "events")
        self.reuse = reuse
        self._prof: DataFrame | None = None

    @property
    def raw(self) -> DataFrame:
        return fixtures.usage_rows(self.events)

    @property
    def prof(self) -> DataFrame:
        if self._prof is None:
            prof = op.sum_by_key(self.raw, "user_id", PROFILE_COLUMNS)
            self._prof = materialize(prof) if self.reuse else prof
        return self._prof

    @property
    def norm(self) -> DataFrame:
        return op.l2_normalize(self.prof, PROFILE_COLUMNS)

    @property
    def thresholds(self) -> DataFrame:
        return op.thresholds(self.norm, PROFILE_COLUMNS)

    @property
    def tags(self) -> DataFrame:
        norm = self.norm
        return op.flag_above(norm, PROFILE_COLUMNS, op.thresholds(norm, PROFILE_COLUMNS),
                             keep=["user_id"])


def tags_from_usage(usage: DataFrame, key: str = "user_id", cols=PROFILE_COLUMNS,
                 buckets: int = 5) -> DataFrame:
    """The whole chain on any raw usage frame: sum -> normalise -> threshold -> flag."""
    norm = op.l2_normalize(op.sum_by_key(usage, key, cols), cols)
    return op.flag_above(norm, cols, op.thresholds(norm, cols, buckets), keep=[key])
