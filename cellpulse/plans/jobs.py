"""The three analyses as batch jobs: read the tables, write the results.

    python -m cellpulse.plans.jobs device|score|profile|spatial --data DIR --out DIR

``--out`` must be a folder every executor can write (shared storage on a
cluster). Each job writes its outputs under ``<out>/<job>/``.
"""

from __future__ import annotations

import argparse
import functools
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..constants import DEVICE_CATEGORICAL, DEVICE_NUMERIC, FOREST_PARAMS, LAST_PERIOD
from ..operators import bundle, change, features, model, spatial
from ..operators.dictionary import CategoryDictionary
from ..session import materialize
from ..sources import csv as io
from ..sources.folders import Published, current, scratch_scope
from .device import DeviceInputs
from .profile import ProfileInputs
from .spatial import SpatialInputs


def scoped(job: Callable) -> Callable:
    """A job that leaves its results and nothing else: scratch tables and checkpoints go when it ends."""
    @functools.wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        with scratch_scope(spark):
            return job(spark, *args, **kwargs)
    return run


def publish_predictions(spark: SparkSession, scored, out: str) -> None:
    """The new predictions take the place of the old ones when all of them are written."""
    scored = materialize(scored)

    def all_there(path: str) -> None:
        if io.read_predictions(spark, path).count() != scored.count():
            raise OSError(f"{path} lacks predictions")

    Published(spark, f"{out}/predictions").publish(lambda path: io.write_predictions(scored, path), all_there, keep=2)


@scoped
def device_job(spark: SparkSession, data: str, out: str, targets: str | None = None, **forest) -> None:
    """Change set, labelled rows, forest on the 8/9 split, hold-out metrics,
    and predictions for every target's last-period record.

    ``targets`` is a text file of ids; without it the derived target list is
    written to ``<out>/targets`` and read from there. The dictionary of
    categories in ``<out>/dictionary`` grows and keeps its indices; the bundle
    in ``<out>/model`` scores later months with it (``score_job``).
    """
    d = DeviceInputs(spark, data, reuse=True)
    if targets is None:
        targets = f"{out}/targets"
        io.write_ids(d.targets, targets)
    wanted = io.read_ids(spark, targets)
    changes = change.changed_between_periods(d.snap, wanted)
    changes.write.mode("overwrite").parquet(f"{out}/changes")
    labeled = change.label_previous_period(d.snap, wanted, spark.read.parquet(f"{out}/changes"))
    known = CategoryDictionary(spark, f"{out}/dictionary")
    version = known.grow(d.snap, DEVICE_CATEGORICAL)
    index = known.read(version).select("column", "value", "idx")
    arity = features.arities(index)
    rows = features.feature_rows(labeled, index)
    split = materialize(model.holdout_split(rows, F.concat_ws("-", "user_id", "period"), (8, 1)))
    train, holdout = (model.assembled(split.where(F.col("split") == part), DEVICE_CATEGORICAL, DEVICE_NUMERIC, arity)
                      for part in ("train", "holdout"))
    fitted = model.fit_forest(train, **{**FOREST_PARAMS, **forest})
    bundle.save(fitted, f"{out}/model", version, arity, DEVICE_CATEGORICAL, DEVICE_NUMERIC, spark)
    scored = model.score(fitted, holdout, ["label"])
    model.confusion(scored, classes=[0, 1]).write.mode("overwrite").parquet(f"{out}/confusion")
    # Read back: the hold-out is scored once.
    conf = spark.read.parquet(f"{out}/confusion")
    model.binary_metrics(conf).write.mode("overwrite").parquet(f"{out}/metrics")
    current_rows = change.rows_in_period(d.snap, wanted, LAST_PERIOD)
    publish_predictions(spark, bundle.score_rows(bundle.load(spark, f"{out}/model"), current_rows, known, ["user_id"]), out)


@scoped
def score_job(spark: SparkSession, data: str, out: str, period: int = LAST_PERIOD) -> None:
    """Score the targets' records of one period with the model that an earlier device job left in ``out``."""
    wanted = io.read_ids(spark, f"{out}/targets")
    rows = change.rows_in_period(DeviceInputs(spark, data, periods=(period, period)).snap, wanted, period)
    known = CategoryDictionary(spark, f"{out}/dictionary")
    publish_predictions(spark, bundle.score_rows(bundle.load(spark, f"{out}/model"), rows, known, ["user_id"]), out)


@scoped
def profile_job(spark: SparkSession, data: str, out: str) -> None:
    """Per-user tags (and the thresholds that made them)."""
    p = ProfileInputs(spark, data, reuse=True)
    p.thresholds.write.mode("overwrite").parquet(f"{out}/thresholds")
    Published(spark, f"{out}/tags").publish(lambda path: io.write_tags(p.tags, path), keep=2)


@scoped
def spatial_job(spark: SparkSession, data: str, out: str, area: int = 0, hour: int = 10,
                tags: str | None = None) -> None:
    """Located records (one folder per area) and the tag report for one area and hour.

    ``tags`` is the tag folder a profile job wrote; without it the tags are
    derived here (a second pass over the events). The report reads the folder
    of its area alone; an area without records gives an empty report.
    """
    located = SpatialInputs(spark, data).clus
    io.write_located_by_area(located, f"{out}/located")
    back = io.read_located(spark, f"{out}/located", area=area)
    tag_rows = io.read_tags(spark, current(spark, tags)) if tags else ProfileInputs(spark, data, reuse=True).tags
    hot = spatial.hot_keys(back.where(F.col("hr") == hour), "user_id")
    report = spatial.located_with_tags(back, tag_rows, area=area, hour=hour, hot=hot)
    report.write.mode("overwrite").parquet(f"{out}/report")


JOBS = {"device": device_job, "score": score_job, "profile": profile_job, "spatial": spatial_job}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("job", choices=sorted(JOBS))
    ap.add_argument("--data", required=True, help="folder with the parquet tables")
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--master", default=None)
    ap.add_argument("--tags", default=None, help="spatial: tag folder written by the profile job")
    ap.add_argument("--targets", default=None, help="device: text file with the ids to score")
    ap.add_argument("--input-bytes", type=int, default=None,
                    help="total input size; sizes scan splits and shuffle partitions")
    args = ap.parse_args(argv)
    from ..session import build_session, scale_conf
    extra = scale_conf(args.input_bytes) if args.input_bytes else None
    spark = build_session(args.master, f"cellpulse-{args.job}", extra=extra)
    # Scoring goes on where the device job left off.
    out = f"{args.out.rstrip('/')}/{'device' if args.job == 'score' else args.job}"
    if args.job == "spatial":
        spatial_job(spark, args.data, out, tags=args.tags)
    elif args.job == "device":
        device_job(spark, args.data, out, targets=args.targets)
    else:
        JOBS[args.job](spark, args.data, out)


if __name__ == "__main__":
    main()
