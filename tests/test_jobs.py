"""The three batch jobs end to end on the smallest tables."""

from cellpulse.plans import jobs
from cellpulse.plans.device import DeviceInputs
from cellpulse.session import checkpoint_root, scratch_path
from cellpulse.sources import csv as io
from cellpulse.sources import folders
from cellpulse.sources.folders import Published, current
from conftest import SF_SMALL


def test_device_job_writes_predictions_for_every_target(spark):
    out = scratch_path(spark, "t-job-device")
    jobs.device_job(spark, SF_SMALL, out, numTrees=3, maxDepth=5)
    preds = io.read_predictions(spark, current(spark, f"{out}/predictions"))
    d = DeviceInputs(spark, SF_SMALL)
    scored = d.snap.where("period = 12").join(d.targets, "user_id", "left_semi")
    assert 0 < preds.count() == scored.count() < d.targets.count()
    given = scratch_path(spark, "t-given")
    io.write_ids(d.targets.limit(3), given)
    jobs.device_job(spark, SF_SMALL, f"{out}-given", targets=given, numTrees=2, maxDepth=3)
    assert io.read_predictions(spark, current(spark, f"{out}-given/predictions")).count() <= 3
    assert spark.read.parquet(f"{out}/metrics").count() == 1
    conf = spark.read.parquet(f"{out}/confusion").collect()
    assert sum(r.pred_0 + r.pred_1 for r in conf) > 0


def test_score_job_goes_on_with_the_saved_model(spark):
    out = scratch_path(spark, "t-job-score")
    jobs.device_job(spark, SF_SMALL, out, numTrees=3, maxDepth=5)
    first = sorted(map(tuple, io.read_predictions(spark, current(spark, f"{out}/predictions")).collect()))
    jobs.score_job(spark, SF_SMALL, out)
    assert Published(spark, f"{out}/predictions").versions() == [1, 2]
    assert sorted(map(tuple, io.read_predictions(spark, current(spark, f"{out}/predictions")).collect())) == first


def test_a_job_leaves_no_scratch_tables(spark):
    out = scratch_path(spark, "t-job-scope")
    root, checkpoints = f"{checkpoint_root(spark).rstrip('/')}/cellpulse", spark.sparkContext.getCheckpointDir()
    before = {path: set(folders.children(spark, path)) for path in (root, checkpoints)}
    jobs.device_job(spark, SF_SMALL, out, numTrees=2, maxDepth=3)
    jobs.profile_job(spark, SF_SMALL, f"{out}/profile")
    assert set(folders.children(spark, checkpoints)) <= before[checkpoints] | {"cellpulse"}
    assert set(folders.children(spark, root)) - before[root] == {out.rsplit("/", 1)[1]}


def test_profile_and_spatial_jobs(spark):
    out = scratch_path(spark, "t-job-prof")
    jobs.profile_job(spark, SF_SMALL, out)
    tags = io.read_tags(spark, current(spark, f"{out}/tags"))
    users = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct().count()
    assert tags.count() == users
    out2 = scratch_path(spark, "t-job-spatial")
    jobs.spatial_job(spark, SF_SMALL, out2)
    report = spark.read.parquet(f"{out2}/report")
    out3 = scratch_path(spark, "t-job-spatial-tags")
    jobs.spatial_job(spark, SF_SMALL, out3, tags=f"{out}/tags")
    assert spark.read.parquet(f"{out3}/report").exceptAll(report).count() == 0
    assert report.columns[:7] == ["user_id", "dt", "hr", "x", "y", "areaid", "clusterid"]
    assert report.where("areaid != 0 or hr != 10").count() == 0


def test_cli_runs_a_job_with_scale_settings(spark):
    from cellpulse.session import scale_conf
    keys = list(scale_conf(10**9))
    before = {k: spark.conf.get(k, None) for k in keys}
    out = scratch_path(spark, "t-cli")
    try:
        jobs.main(["profile", "--data", SF_SMALL, "--out", out, "--input-bytes", str(10**9)])
        assert io.read_tags(spark, current(spark, f"{out}/profile/tags")).count() > 0
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(128 << 20)
    finally:   # the session is shared with the other tests
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
