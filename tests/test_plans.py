"""Plan shape of every query key: the properties that matter at scale."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from cellpulse.plans.queries import REGISTRY
from conftest import SF_SMALL

MODEL_KEYS = {"rf_grid_cv", "rf_fit_predict", "rf_separable", "predict_target"}
KEYS = [k for k in REGISTRY if k not in MODEL_KEYS]
# Keys that aggregate raw events by user: the aggregate must be partial before the shuffle.
EVENT_AGGREGATES = {"period_snapshot", "profile_sum", "unpivot_hours", "distinct_users",
                    "l2_normalize", "category_distinct"}
# Keys that read a derived frame several times and use its materialised copy.
MATERIALISED = {"device_switch", "label_prev_period", "feature_rows",
                "tag_flags", "tag_sum", "feature_histogram"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="extended")
    return buf.getvalue().split("== Physical Plan ==")[-1]


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_text(entry.queries()[k](spark, SF_SMALL)) for k in KEYS}


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_or_python(plans, key):
    plan = plans[key]
    assert "CartesianProduct" not in plan
    assert "EvalPython" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("key", KEYS)
def test_no_nested_loop_join(plans, key):
    assert "BroadcastNestedLoopJoin" not in plans[key]


@pytest.mark.parametrize("key", KEYS)
def test_events_scan_is_pruned(plans, key):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[key]):
        if "event_type" in schema and key != "field_count_profile":
            assert "props" not in schema, schema


@pytest.mark.parametrize("key", sorted(EVENT_AGGREGATES))
def test_event_aggregates_are_partial_before_shuffle(plans, key):
    plan = plans[key]
    assert "partial_" in plan or re.search(r"HashAggregate\(keys=\[[^\]]+\], functions=\[\]", plan)


@pytest.mark.parametrize("key", sorted(MATERIALISED))
def test_materialised_queries_do_not_rescan_events(plans, key):
    assert "events.parquet" not in plans[key]


def test_lines_of_five_formats_share_the_profile(plans):
    """Device and located records read events; usage and tag lines read one checkpoint."""
    assert len(re.findall(r"FileScan parquet .*events\.parquet", plans["record_to_line"])) == 2


def test_period_filter_prunes_device_log_folders(spark):
    from pyspark.sql import functions as F

    from cellpulse.plans.device import DeviceInputs
    from cellpulse.session import scratch_path
    from cellpulse.sources import csv as io
    path = scratch_path(spark, "t-prune")
    io.write_device_logs(DeviceInputs(spark, SF_SMALL).snap, path)
    one = io.read_device_logs(spark, path).where(F.col("period") == 12)
    plan = plan_text(one)
    assert re.search(r"PartitionFilters: \[[^\]]*period[^\]]*= 12", plan), plan
    assert one.count() == DeviceInputs(spark, SF_SMALL).snap.where(F.col("period") == 12).count()


def test_date_filter_reaches_parquet_as_ts_range(plans):
    plan = plans["where_date"]
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-05", plan), plan
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts,2024-01-06", plan), plan


def test_one_period_questions_read_a_range_of_ts(spark, plans):
    from cellpulse.plans import fixtures
    from cellpulse.sources.tables import read_table
    events = read_table(spark, SF_SMALL, "events")
    for first, plan in ((11, plan_text(fixtures.device_snapshot(fixtures.in_periods(events, 11, 12)))),
                        (12, plans["target_scoring_rows"])):
        start = {11: "2024-01-26", 12: "2024-01-29"}[first]
        assert re.search(rf"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,{start}", plan), plan
        assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts,2024-01-31", plan), plan


def test_one_period_results_equal_the_filtered_whole(spark):
    from pyspark.sql import functions as F
    q = entry.queries()
    for one, whole in (("switch_one_period", "device_switch"), ("label_one_period", "label_prev_period")):
        want = q[whole](spark, SF_SMALL).where(F.col("period") == 12)
        got = q[one](spark, SF_SMALL)
        assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_snapshot_is_hash_aggregated(plans):
    assert "SortAggregate" not in plans["period_snapshot"] and "HashAggregate" in plans["period_snapshot"]


def test_no_exchange_on_a_category_or_area(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = plan_text(entry.queries()["feature_rows"](spark, SF_SMALL))
        for c in ("net", "gender", "age", "arpu", "bytes", "value", "vendor"):
            assert not re.search(rf"hashpartitioning\({c}#", plan), plan
        # The one exchange on the area gathers the centres; the points are joined by broadcast.
        plan = plan_text(entry.queries()["nearest_centre"](spark, SF_SMALL))
        assert len(re.findall(r"hashpartitioning\(areaid#", plan)) == 1 and "hashpartitioning(_cell_x" not in plan
        assert "BroadcastHashJoin [areaid#" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(key, before)
