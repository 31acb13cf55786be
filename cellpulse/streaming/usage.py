"""Usage sums over a growing directory of event files (Structured Streaming).

The profile sum is re-aggregatable: sums of per-batch sums equal the sum
over all rows. So each micro-batch writes its own per-user partial sums
(no unbounded streaming state), and readers fold the partials with the same
``sum_by_key`` operator. A batch overwrites only its own ``batch_id``
partition, so a replay after a failure is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import PROFILE_COLUMNS
from ..operators.profile import sum_by_key
from ..plans.fixtures import usage_rows

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def event_stream(spark: SparkSession, source_dir: str, glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def start_partial_sums(events: DataFrame, out_path: str, available_now: bool = True) -> StreamingQuery:
    """Write per-batch partial sums to ``out_path`` (parquet, one folder per batch).

    The stream's progress is kept beside its output, in a folder that readers
    skip: a second start on the same output goes on where the first ended
    and counts no file twice.
    """
    checkpoint = f"{out_path.rstrip('/')}/_progress"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        partial = sum_by_key(usage_rows(batch), "user_id", PROFILE_COLUMNS)
        (partial.withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(out_path))

    writer = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_usage_sums(spark: SparkSession, out_path: str) -> DataFrame:
    """Current per-user sums: the partial sums of all batches folded together."""
    return sum_by_key(spark.read.parquet(out_path).drop("batch_id"), "user_id", PROFILE_COLUMNS)
