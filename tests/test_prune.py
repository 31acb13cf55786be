"""Keys kept before a shuffle: both ways exact, target rows only in the label shuffle."""

import pytest

from cellpulse.operators import change, prune
from cellpulse.plans.device import DeviceInputs
from cellpulse.session import materialize
from conftest import SF_CHECK


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 0}, {"max_bytes": 0, "bits": 1 << 15}])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_keep_keys_is_a_semi_join(spark, limits, kind):
    rows = spark.range(4_000).selectExpr(f"cast(id % 900 as {kind}) k", "id v").unionByName(
        spark.createDataFrame([(None, -1)], f"k {kind}, v bigint"))
    keys = spark.range(0, 900, 7).selectExpr(f"cast(id as {kind}) k").unionByName(spark.createDataFrame([(None,)], f"k {kind}"))
    want = sorted(r.v for r in rows.join(keys, "k", "left_semi").collect())
    assert sorted(r.v for r in prune.keep_keys(rows, keys, "k", **limits).collect()) == want
    loose = sorted(r.v for r in prune.keep_keys(rows, keys, "k", exact=False, **limits).collect())
    assert set(want) <= set(loose) and len(loose) < 4_000
    if limits.get("bits") is None:
        assert loose == want
    assert prune.keep_keys(rows, keys.where("false"), "k", **limits).count() == 0


def test_bitmap_is_bounded(spark):
    keys = spark.range(200_000).withColumnRenamed("id", "k")
    bitmap = prune.key_bitmap(keys, "k", 1 << 17).collect()
    assert len(bitmap) <= (1 << 17) // 32_768 and all(len(r["_bits"]) == 4_096 for r in bitmap)


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 0}])
def test_label_shuffle_holds_target_rows_only(spark, limits):
    d = DeviceInputs(spark, SF_CHECK, reuse=True)
    targets = materialize(d.targets.limit(20))
    changes = change.changed_between_periods(d.snap, targets)
    rows = change.label_rows(d.snap, targets, changes, **limits)
    periods = d.snap.select("period").distinct().count()
    assert d.snap.count() > 20 * periods * 3
    assert rows.count() <= 20 * periods * 3
    got = change.label_previous_period(d.snap, targets, changes, **limits)
    assert got.count() == 20 * (periods - 2)
    whole = change.label_previous_period(d.snap, d.targets, change.changed_between_periods(d.snap, d.targets))
    assert got.exceptAll(whole).count() == 0


def test_snapshot_meets_the_targets_before_any_exchange(spark):
    d = DeviceInputs(spark, SF_CHECK, reuse=True)
    plan = change.label_previous_period(d.snap, d.targets, d.switch)._jdf.queryExecution().sparkPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line or "Join LeftSemi" in line or "BroadcastHash" in line for line in semi)
    assert "SortMergeJoin" not in plan
