"""Located records joined with tags when one user holds a third of them."""

import pytest
from pyspark.sql import functions as F

from cellpulse.operators import spatial

OFF = {"spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
       "spark.sql.shuffle.partitions": "12"}


@pytest.fixture()
def plain_joins(spark):
    before = {k: spark.conf.get(k, None) for k in OFF}
    for k, v in OFF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def frames(spark):
    located = spark.range(0, 60_000, 1, 6).selectExpr(
        "case when id % 3 = 0 then 7 when id % 1000 = 1 then null else id % 5000 end as user_id",
        "date '2024-01-01' as dt", "cast(id % 24 as int) hr", "cast(id as double) x")
    tags = spark.range(0, 5_000).where("id % 4 != 2").selectExpr("id as user_id", "cast(id % 2 as int) fa")
    return located, tags


def test_hot_keys_are_found_and_bounded(spark, frames):
    located, _ = frames
    assert spatial.hot_keys(located, "user_id") == [7]
    assert spatial.hot_keys(located.limit(0), "user_id") == []
    assert len(spatial.hot_keys(spark.range(1000).withColumnRenamed("id", "k"), "k", 0.0001)) == 1000


@pytest.mark.parametrize("max_bytes", [None, 0])
def test_same_rows_as_the_plain_join(spark, frames, max_bytes):
    located, tags = frames
    right = tags.unionByName(tags.where("user_id = 7").selectExpr("user_id", "fa + 5 as fa")).withColumnRenamed("user_id", "tag_user_id")
    want = located.join(right, located["user_id"] == right["tag_user_id"], "left")
    got = spatial.join_split_by_heat(located, right, "user_id", "tag_user_id", [7, 2], max_bytes)
    assert got.columns == want.columns and got.count() == want.count() > 80_000
    assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("max_bytes", [None, 0])
def test_no_task_holds_the_hot_user(spark, frames, plain_joins, max_bytes):
    located, tags = frames
    right = tags.withColumnRenamed("user_id", "tag_user_id")

    def sizes(frame):
        return sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())

    # With the plain join one task has a third of the rows.
    plain = sizes(located.join(right, located["user_id"] == right["tag_user_id"], "left"))
    assert plain[-1] > 20_000
    split = sizes(spatial.join_split_by_heat(located, right, "user_id", "tag_user_id", spatial.hot_keys(located, "user_id"), max_bytes))
    assert sum(split) == 60_000 and split[-1] <= 3 * split[len(split) // 2]
