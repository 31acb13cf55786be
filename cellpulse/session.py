"""Session set-up and the few cluster-facing helpers every plan shares.

Nothing here reaches into Spark internals: it only sets public configs,
reads ``spark.checkpoint.dir`` and wraps ``F.broadcast`` behind a size check.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sides we broadcast must stay far below executor memory.
DEFAULT_BROADCAST_BYTES = 32 << 20


def build_session(master: str | None = None, app_name: str = "cellpulse",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with AQE, skew-join splitting and UTC time.

    On a cluster the deploy tooling sets ``master``; locally pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scale_conf(input_bytes: int, shuffled_share: float = 0.02,
               partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition settings derived from the size of the input.

    Scan splits are 128 MB, and larger beyond 12 TB so that there are about
    100,000 of them. What is shuffled is the output of partial aggregates,
    ``shuffled_share`` of the input, at ``partition_bytes`` per partition; AQE
    coalesces down from there. E.g. 100 TB -> 100,000 scan tasks of 1 GB,
    7,450 shuffle partitions, 7.5e8 shuffle blocks.
    """
    split = max(128 << 20, input_bytes // 100_000)
    parts = max(8, int(input_bytes * shuffled_share) // partition_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session checkpoints to (``spark.checkpoint.dir``).

    The cluster owns this setting; Spark derives a per-application folder
    from it. Only a local-mode session without one (a laptop, a bare test
    session) gets a fresh folder of its own; a cluster session without one
    is an error, because a machine-local folder would not be visible to
    other executors and would not survive losing one.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="cellpulse-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


#: Scratch paths given out by this process, for ``folders.scratch_scope``.
SCRATCH_PATHS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/cellpulse/{name}-{uuid.uuid4().hex}"
    SCRATCH_PATHS.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder.

    For a frame that several branches of one plan read: they all read the
    checkpoint instead of recomputing it, lineage is cut, and a lost
    executor does not replay the work (unlike ``localCheckpoint`` or cache).
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame):
    """Upper estimate of a row's size: text by its bytes, anything else by 16, and overhead."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in df.dtypes]
    total = F.lit(16).cast("long")
    for size in sizes:
        total = total + size
    return total


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES,
                      known_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when it provably has at most ``max_bytes`` bytes.

    ``known_bytes`` is a bound the caller already holds (a table built from a
    fixed list); otherwise one aggregate adds up the rows' sizes. Beyond the
    bound the frame is returned as is, so the planner falls back to a shuffle
    join (and AQE may still broadcast it from runtime statistics). The result
    of a join is the same either way. ``df`` should be a table or a
    checkpoint: the check computes it.
    """
    size = known_bytes if known_bytes is not None else df.agg(F.sum(_row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def env_int(name: str, default: int) -> int:
    value = os.environ.get(name)
    return int(value) if value else default
