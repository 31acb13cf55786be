"""Months added one by one equal the whole run, and no month is shuffled."""

import pytest

from cellpulse.operators import change
from cellpulse.plans.device import DeviceInputs
from cellpulse.plans.monthly import MonthStore
from cellpulse.session import scratch_path
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def whole(spark):
    return DeviceInputs(spark, SF_SMALL, reuse=True)


@pytest.fixture(scope="module")
def store(spark, whole):
    root = scratch_path(spark, "t-months")
    for month in range(1, 13):
        MonthStore(spark, root, buckets=4).append(month, whole.snap.where(f"period = {month}"))
    return MonthStore(spark, root)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_every_month_as_the_whole_run(spark, whole, store):
    assert store.months() == list(range(1, 13)) and store.buckets == 4
    all_changes, all_labels = whole.switch.collect(), whole.labeled.collect()
    for month in range(1, 13):
        assert rows(store.changes_of(month, whole.targets)) == sorted((tuple(r) for r in all_changes if r.period == month), key=repr)
    for month in (1, 2, 9, 12):
        assert rows(store.labels_of(month, whole.targets)) == sorted((tuple(r) for r in all_labels if r.period == month), key=repr)
    assert rows(store.read(5)) == rows(whole.snap.where("period = 5"))


def test_no_month_is_shuffled(spark, whole, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = store.changes_of(12, whole.targets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    assert plan.count("Bucketed: true") == 2


def test_a_month_can_be_replaced_and_must_have_the_columns(spark, whole):
    root = scratch_path(spark, "t-months")
    store = MonthStore(spark, root, buckets=2)
    store.append(3, whole.snap.where("period = 3"))
    store.append(3, whole.snap.where("period = 3 and user_id % 2 = 0"))
    assert store.read(3).where("user_id % 2 = 1").count() == 0 < store.read(3).count()
    assert rows(store.changes_of(3, whole.targets)) == []  # no month before it
    with pytest.raises(ValueError):
        store.append(4, whole.snap.where("period = 4").drop("sms"))
    with pytest.raises(FileNotFoundError):
        store.read(4)
    assert spark.catalog.listTables() == [] or all("cellpulse_month" not in t.name for t in spark.catalog.listTables())


def test_nulls_block_a_change_as_in_the_whole_run(spark):
    snap = spark.createDataFrame([(2, 1, "a", "x"), (3, 1, None, "y"), (2, 2, "a", "x"), (3, 2, "b", "y"), (3, 3, "b", "y")],
                                 "period int, user_id bigint, vendor string, dtype string")
    targets = spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id bigint")
    store = MonthStore(spark, scratch_path(spark, "t-months"), buckets=2)
    for month in (2, 3):
        store.append(month, snap.where(f"period = {month}"))
    assert rows(store.changes_of(3, targets)) == rows(change.changed_between_periods(snap, targets).where("period = 3")) != []
