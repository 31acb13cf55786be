"""Bad tokens with their place, sketches of months."""

import os

import pytest
from pyspark.sql import functions as F

from cellpulse.operators import quality
from cellpulse.session import scratch_path
from cellpulse.sources.rejects import TooManyRejects, read_checked
from conftest import local_path

SCHEMA = "id bigint, name string, n int"


def folder(spark, files):
    root = scratch_path(spark, "t-rejects")
    os.makedirs(local_path(root))
    for name, lines in files.items():
        with open(f"{local_path(root)}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    return root


def places(found):
    return sorted((os.path.basename(r.file), r.line, r.field, r.token) for r in found.rejects.collect())


def test_every_reject_with_its_place(spark):
    root = folder(spark, {"a.csv": ["id,name,n", '1,"x, y",5', "2,b,", "z3,c,7", "4,d,1e", ",e,"],
                          "b.csv": ["id,name,n", "q,r,s", "5,f,6", "6,g"]})
    found = read_checked(spark, root, SCHEMA, most=0.5, header=True)
    assert places(found) == [("a.csv", 4, "id", "z3"), ("a.csv", 5, "n", "1e"), ("b.csv", 2, "id", "q"), ("b.csv", 2, "n", "s")]
    assert (found.n_read, found.n_rejected) == (8, 3)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == sorted(
        [(1, "x, y", 5), (2, "b", None), (None, "e", None), (5, "f", 6), (6, "g", None)], key=repr)
    assert found.rows.dtypes == [("id", "bigint"), ("name", "string"), ("n", "int")]


def test_lines_of_a_file_that_is_split(spark):
    lines = [f"{i},{'name' * (i % 5)},{i if i % 250 else 'bad%d' % i}" for i in range(6_000)]
    root = folder(spark, {"big.csv": lines, "small.csv": lines[:300]})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        found = read_checked(spark, root, SCHEMA)
        assert found.rows.rdd.getNumPartitions() > 4
        got = places(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("big.csv", i + 1, "n", f"bad{i}") for i in range(0, 6_000, 250)]
                         + [("small.csv", i + 1, "n", f"bad{i}") for i in (0, 250)])


def test_too_many_rejects_end_the_job_and_name_one(spark):
    root = folder(spark, {"a.csv": ["1,a,x", "2,b,3"]})
    with pytest.raises(TooManyRejects, match=r"1 of 2 rows.*'x' for n in line 1 of .*a\.csv"):
        read_checked(spark, root, SCHEMA, most=0.4)
    assert read_checked(spark, root, SCHEMA, most=0.5).n_rejected == 1
    assert read_checked(spark, root, SCHEMA, most=0, strict=["id"]).rows.count() == 2


def test_no_rows_and_no_rejects(spark):
    root = folder(spark, {"a.csv": ["id,name,n"]})
    found = read_checked(spark, root, SCHEMA, header=True)
    assert (found.n_read, found.n_rejected, found.rows.count(), found.rejects.count()) == (0, 0, 0, 0)


def test_sketches_of_months_add_up(spark):
    """Half of a month's users are those of the month before."""
    rows = spark.range(0, 80_000).selectExpr("cast(id div 20000 as int) as m", "cast(id % 20000 + (id div 20000) * 10000 as bigint) as u")
    rows = rows.unionByName(spark.createDataFrame([(0, None), (9, None)], "m int, u bigint"))
    sketches = quality.distinct_sketches(rows, "m", "u")
    assert max(r.n for r in sketches.select(F.length("sketch").alias("n")).collect()) < 20_000
    each = {r.m: r.estimate for r in quality.merged_distinct(sketches, "m").collect()}
    assert each.pop(9) == 0 and all(abs(n - 20_000) < 600 for n in each.values())
    assert abs(quality.merged_distinct(sketches).first().estimate - 50_000) < 1_500
    assert quality.merged_distinct(sketches.limit(0)).first().estimate in (0, None)
