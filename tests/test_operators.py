"""Operator edge cases on small literal frames."""

import os

import pytest
from pyspark.sql import functions as F

from cellpulse.constants import PROFILE_COLUMNS
from cellpulse.functions import text
from cellpulse.operators import change, features, model, profile, quality, spatial
from cellpulse.session import scratch_path
from cellpulse.sources import csv as io
from conftest import local_path

SNAP = "user_id bigint, period int, vendor string, dtype int, voice int, sms int"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- change detection ------------------------------------------------------------

def test_change_needs_both_attributes_and_adjacent_periods(spark):
    snap = spark.createDataFrame([
        (1, 2, "a", 1, 0, 0), (1, 3, "b", 2, 0, 0),   # both differ -> change in 3
        (2, 2, "a", 1, 0, 0), (2, 3, "a", 2, 0, 0),   # same vendor, other type -> none
        (3, 2, "a", 1, 0, 0), (3, 4, "b", 2, 0, 0),   # period 3 missing -> none in 4
        (4, 8, "a", 1, 0, 0), (4, 9, "b", 2, 0, 0),   # period 9 skipped
        (5, 5, None, 1, 0, 0), (5, 6, "b", 2, 0, 0),  # null vendor -> none
    ], SNAP)
    targets = spark.createDataFrame([(u,) for u in range(1, 6)], "user_id bigint")
    out = change.changed_between_periods(snap, targets)
    assert rows(out, "user_id") == [(3, 1, "b", 2, "a", 1)]
    any_mode = change.changed_between_periods(snap, targets, mode="any")
    assert {r.user_id for r in any_mode.collect()} == {1, 2, 5}  # null OR true = true


def test_change_only_for_targets(spark):
    snap = spark.createDataFrame([(1, 2, "a", 1, 0, 0), (1, 3, "b", 2, 0, 0)], SNAP)
    targets = spark.createDataFrame([(7,)], "user_id bigint")
    assert change.changed_between_periods(snap, targets).count() == 0


def test_labels_cover_targets_times_periods(spark):
    snap = spark.createDataFrame([
        (1, 1, "a", 1, 5, 6), (1, 2, "b", 2, 7, 8), (1, 3, "b", 2, 9, 9),
        (2, 2, "a", 1, 1, 1),                           # user 2 missing in periods 1, 3
    ], SNAP)
    targets = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    sw = change.changed_between_periods(snap, targets)
    lab = change.label_previous_period(snap, targets, sw, behaviour=("vendor", "dtype", "voice", "sms"))
    got = rows(lab, "period", "user_id")
    assert got == [
        (2, 1, "a", 1, 5, 6, 1),        # behaviour of period 1, changed in 2
        (2, 2, None, None, None, None, 0),
        (3, 1, "b", 2, 7, 8, 0),
        (3, 2, "a", 1, 1, 1, 0),
    ]


def test_latest_per_key_picks_largest_order(spark):
    df = spark.createDataFrame([(1, 1, 10, "x"), (1, 1, 30, "z"), (1, 1, 20, "y"), (2, 1, 5, "q")],
                               "u int, p int, id int, v string")
    out = change.latest_per_key(df, ["u", "p"], "id", ["v"])
    assert rows(out, "u") == [(1, 1, "z"), (2, 1, "q")]
    # Beyond the bound on distinct texts the plan changes, not the result; nulls stay null.
    assert rows(change.latest_per_key(df, ["u", "p"], "id", ["v"], max_codes=2), "u") == rows(out, "u")
    empty = change.latest_per_key(df.where("u > 9"), ["u", "p"], "id", ["v"], keep_order=True)
    assert empty.columns == ["u", "p", "v", "id"] and empty.count() == 0
    nulls = spark.createDataFrame([(1, 1, 10, "x"), (1, 1, 30, None)], "u int, p int, id int, v string")
    assert change.latest_per_key(nulls, ["u", "p"], "id", ["v"], keep_order=True).first().id == 30


# --- profile -----------------------------------------------------------------------

def test_l2_normalize_zero_row_unchanged(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 0.0)], "k int, a double, b double")
    out = rows(profile.l2_normalize(df, ["a", "b"]), "k")
    assert out == [(1, 0.6, 0.8), (2, 0.0, 0.0)]


def test_thresholds_and_flags_constant_feature(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, 5.0, 2.0), (3, 4.5, 2.0)],
                               "k int, a double, c double")
    thr = profile.thresholds(df, ["a", "c"])
    t = thr.first()
    assert t.t_a == 0.0 + 4.0 * 5.0 / 5.0 and t.t_c == 2.0
    flags = rows(profile.flag_above(df, ["a", "c"], thr, keep=["k"]), "k")
    assert flags == [(1, 0, 0), (2, 1, 0), (3, 1, 0)]   # 4.5 > 4.0; constant -> never


def test_histogram_has_every_bucket_and_closed_top(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (10.0,), (10.0,)], "a double")
    h = rows(profile.histogram(df, ["a"]), "bucket")
    assert [(r[1], r[3]) for r in h] == [(0, 2), (1, 0), (2, 1), (3, 0), (4, 2)]
    assert [r[2] for r in h] == [0.0, 2.0, 4.0, 6.0, 8.0]
    const = spark.createDataFrame([(3.0,), (3.0,)], "a double")
    assert [r[3] for r in rows(profile.histogram(const, ["a"]), "bucket")] == [2, 0, 0, 0, 0]


def test_sum_by_key_row_count_equals_distinct_keys(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k int, a double")
    assert rows(profile.sum_by_key(df, "k", ["a"]), "k") == [(1, 3.0), (2, 5.0)]


# --- spatial -----------------------------------------------------------------------

def test_unpivot_drops_points_with_a_zero_axis(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0, 0.0, 3.0, 4.0, 0.0)],
                                 "k int, x0 double, y0 double, x1 double, y1 double, "
                                 "x2 double, y2 double")
    out = rows(spatial.unpivot_hours(wide, ["k"], hours=3), "hr")
    assert out == [(1, 0, 1.0, 2.0)]


def test_area_closed_bounds_and_grid_path_agree(spark):
    areas = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0), (1, 2.0, 3.0, 2.0, 3.0)],
                                  "areaid int, x_min double, x_max double, y_min double, "
                                  "y_max double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.0), (3, 1.5, 1.5), (4, 2.5, 3.0)],
                                "k int, x double, y double")
    small = rows(spatial.assign_area(pts, areas), "k")
    assert small == [(1, 1.0, 1.0, 0), (2, 0.5, 0.0, 0), (4, 2.5, 3.0, 1)]
    for cell, size in ((0.7, None), (0.7, 10**12), (0.05, None), (50.0, None)):
        assert rows(spatial.assign_area(pts, areas, cell=cell, known_bytes=size), "k") == small
    huge = spark.createDataFrame([(0, -1e6, 1e6, -1e6, 1e6), (1, 2.0, 3.0, 2.0, 3.0)],
                                 "areaid int, x_min double, x_max double, y_min double, y_max double")
    assert spatial.assign_area(pts, huge).count() == 5     # a few cells, however large the box


def test_nearest_centre_ties_to_lowest_id(spark):
    cent = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 2.0, 0.0), (0, 2, 10.0, 0.0)],
                                 "areaid int, clusterid int, cx double, cy double")
    pts = spark.createDataFrame([(1, 1.0, 0.0, 0), (2, 1.9, 0.0, 0), (3, 1.0, 0.0, 5)],
                                "k int, x double, y double, areaid int")
    out = rows(spatial.nearest_centre(pts, cent), "k")
    assert out == [(1, 1.0, 0.0, 0, 0), (2, 1.9, 0.0, 0, 1), (3, 1.0, 0.0, 5, None)]
    assert rows(spatial.nearest_centre(pts, cent, max_bytes=0), "k") == out


def test_tag_join_keeps_left_rows(spark):
    loc = spark.createDataFrame([(1, "d", 10, 0, 0), (2, "d", 10, 0, 0), (2, "d", 11, 0, 0)],
                                "user_id int, dt string, hr int, areaid int, clusterid int")
    tags = spark.createDataFrame([(1, 1)], "user_id int, fa int")
    out = spatial.located_with_tags(loc, tags, area=0, hour=10)
    assert out.count() == 2
    assert rows(out.select("user_id", "tag_user_id", "fa"), "user_id") == [(1, 1, 1), (2, None, None)]


# --- features / quality ------------------------------------------------------------

def test_category_index_sorted_and_null_is_unknown(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), ("b", None), ("c", "x")], "v string, w string")
    index = features.category_index(df, ["v", "w"])
    assert rows(index, "column", "value") == [("v", "a", 0), ("v", "b", 1), ("v", "c", 2), ("w", "x", 0), ("w", "y", 1)]
    with_idx = features.with_category_index(df, ["v", "w"], index)
    assert {r.v: r.v_idx for r in with_idx.collect()} == {"a": 0, "b": 1, "c": 2, None: 3}
    assert features.arities(index, ["v", "w"]) == {"v": 4, "w": 3}
    assert ("v", None) in rows(features.distinct_values(df, ["v", "w"]))
    other = features.with_category_index(spark.createDataFrame([("zz",)], "v string"), ["v"], index)
    assert other.first().v_idx == 3


def test_feature_rows_keep_rows_without_a_record(spark):
    df = spark.createDataFrame([("a", 5, 0), (None, None, 1)], "v string, x int, label int")
    index = features.category_index(df, ["v"])
    got = rows(features.feature_rows(df, index, ["v"], ["x"], keep=["label"]), "label")
    assert got == [(0, 0, 5), (1, 1, -1)]


def test_column_profile_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    r = quality.column_profile(df, ["v"]).first()
    assert (r.n, r.mean, r.stdev, r.max, r.min, r.nan) == (2, 2.0, 1.0, 3.0, 1.0, 2)


def test_field_count_right_separator_is_constant(spark):
    lines = spark.createDataFrame([('"a","b,c","d"',), ('"a","b","d"',)], "line string")
    prof = {r.sep: r for r in quality.field_count_profile(lines, "line", [",", '","']).collect()}
    assert prof['","'].stdev == 0.0 and prof['","'].min == 3.0
    assert prof[","].max == 4.0


# --- model -------------------------------------------------------------------------

def test_confusion_and_metrics_all_one_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "label int, prediction int")
    conf = model.confusion(df)
    assert rows(conf, "label") == [(0, 2, 1), (1, 0, 0)]
    m = model.binary_metrics(conf).first()
    assert m.accuracy == 2 / 3 and m.precision_1 == 0.0 and m.recall_1 is None
    assert m.majority_share == 1.0


def test_confusion_keeps_every_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 0), (None, 1)], "label int, prediction int")
    conf = model.confusion(df)
    assert conf.columns == ["label", "pred_0", "pred_1", "pred_2"]
    assert rows(conf, "label") == [(0, 1, 0, 0), (1, 0, 0, 1), (2, 1, 0, 1)]
    got = {r.label: r for r in model.class_metrics(conf).collect()}
    assert got[0].precision == 0.5 and got[0].recall == 1.0 and got[1].recall == 0.0 and got[1].precision is None
    assert got[2].support == 2 and got[2].f1 == 0.5 and got[0].accuracy == 0.5


def test_hash_split_is_stable_and_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = model.holdout_split(df, F.col("k"))
    b = model.holdout_split(df, F.col("k"))
    assert rows(a, "k") == rows(b, "k")
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(counts.values()) == 1000 and 50 < counts["holdout"] < 180


def test_forest_handles_unseen_category(spark):
    train = spark.createDataFrame([("a", 1, 0), ("b", 5, 1)] * 20, "v string, x int, label int")
    index = features.category_index(train, ["v"])
    arity = features.arities(index, ["v"])

    def ready(df, keep):
        return model.assembled(features.feature_rows(df, index, ["v"], ["x"], keep=keep), ["v"], ["x"], arity)

    m = model.fit_forest(ready(train, ["label"]), numTrees=3, maxDepth=3, seed=1)
    assert m.numFeatures == 2
    new = spark.createDataFrame([(1, "zz", 5), (2, None, None)], "k int, v string, x int")
    assert model.score(m, ready(new, ["k"]), ["k"]).count() == 2


def test_grid_search_keeps_a_model_per_point_and_fold(spark):
    df = spark.createDataFrame([(i % 3, i % 2, i % 2) for i in range(60)], "fold int, v_idx int, label int")
    found = model.forest_grid_cv(model.assembled(df, ["v"], [], {"v": 2}),
                                 {"numTrees": [2], "maxDepth": [2, 3]}, folds=3)
    assert [(r.point["maxDepth"], r.fold) for r in found] == [(d, f) for d in (2, 3) for f in range(3)]
    assert all(r.model.getNumTrees == 2 and (r.n_train, r.n_valid) == (40, 20) for r in found)
    assert all(r.f_measure == r.precision == r.recall == 1.0 for r in found)
    assert model.grid_table(spark, found).count() == 6


# --- scalar functions ----------------------------------------------------------------

def test_scalar_functions(spark):
    df = spark.createDataFrame([("ab", 5, 123, '"x"', "")], "s string, n int, m int, q string, e string")
    r = df.select(text.bytes_to_hex("s").alias("h"), text.bytes_to_hex("s", ":").alias("hs"),
                  text.zero_pad("n").alias("p"), text.zero_pad("m").alias("pm"),
                  text.strip_quotes("q").alias("sq"), text.hex_to_decimal(F.lit("ff")).alias("d"),
                  text.to_line(["s", F.lit(None), "n"]).alias("line")).first()
    assert tuple(r) == ("6162", "61:62", "05", "123", "x", "255", "ab,,5")


def test_hex_to_decimal_is_exact_for_whole_ids(spark):
    import hashlib
    ids = ["0", "0" * 32, "f" * 32, "F" * 16, "1" + "0" * 16, "8" + "0" * 31] + [
        hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "h string")
    assert {r.h: r.d for r in df.select("h", text.hex_to_decimal("h").alias("d")).collect()} == {
        i: str(int(i, 16)) for i in ids}
    bad = spark.createDataFrame([(None,), ("",), ("xyz",), ("0" * 33,)], "h string")
    assert {r.d for r in bad.select(text.hex_to_decimal("h").alias("d")).collect()} == {None}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_values_of_the_wrong_type_stop_the_job(spark, ansi):
    path = scratch_path(spark, "t-bad")
    os.makedirs(local_path(path))
    with open(f"{local_path(path)}/part.csv", "w") as f:
        f.write("7,2024-01-02,abc,2.5\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a double in x0: abc"):
            io.read_wide_locations(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


# --- sources -------------------------------------------------------------------------

def test_device_csv_quoted_comma_and_header_per_file(spark):
    path = scratch_path(spark, "t-device")
    df = spark.createDataFrame([(1, 10, "2G", "F", "30-39", "0-49", "v", "U8800,U8800,IDEOSX5", "0-499", 4, 5),
                                (2, 11, "3G", None, "0-9", "0-49", "w", "b", "0-499", 2, 3)], io.DEVICE_LOG_SCHEMA)
    io.write_device_logs(df, path)
    back = io.read_device_logs(spark, path).select(*df.columns)
    assert rows(back, "period") == rows(df, "period")


def test_wide_rows_short_and_long_lines(spark):
    path = scratch_path(spark, "t-wide")
    os.makedirs(local_path(path))
    with open(f"{local_path(path)}/part.csv", "w") as f:
        f.write("7,2024-01-02,1.5,2.5\n")                                    # short row
        f.write("8,2024-01-02," + ",".join(["1"] * 48) + ",9,9\n")         # extra fields
        f.write("9,2024-01-03,,3.0," + ",".join(["0"] * 46) + "\n")       # empty field
    df = io.read_wide_locations(spark, path)
    got = {r.user_id: r for r in df.collect()}
    assert got[7].x0 == 1.5 and got[7].y23 == 0.0
    assert got[8].y23 == 1.0
    assert got[9].x0 == 0.0 and got[9].y0 == 3.0


def test_profile_reader_drops_positions_and_fills_blanks(spark):
    path = scratch_path(spark, "t-prof")
    os.makedirs(local_path(path))
    vals = [str(i) for i in range(1, 24)]
    vals[0] = ""                      # blank -> 0
    with open(f"{local_path(path)}/part.csv", "w") as f:
        f.write('"IMEI",' + ",".join(["h"] * 23) + "\n")
        f.write('"42",' + ",".join(vals) + "\n")
    df = io.read_profiles(spark, path, header_text="IMEI")
    r = df.first()
    assert df.count() == 1 and r.user_id == 42 and r.fa == 0.0
    kept = [float(i) for i in range(1, 24) if i not in (6, 7, 22)]
    kept[0] = 0.0
    assert [r[c] for c in PROFILE_COLUMNS] == kept


def test_centres_round_trip_keeps_line_order(spark):
    root = scratch_path(spark, "t-cent")
    cent = spatial.centre_table(spark)
    io.write_centres(cent, root)
    back = io.read_centres(spark, root)
    assert rows(back, "areaid", "clusterid") == rows(cent, "areaid", "clusterid")


def test_ids_round_trip(spark):
    path = scratch_path(spark, "t-ids")
    ids = spark.createDataFrame([(3,), (1,)], "user_id bigint")
    io.write_ids(ids, path)
    assert rows(io.read_ids(spark, path), "user_id") == [(1,), (3,)]


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("size, fits", [(1, False), (10_000, True)])
def test_bounded_broadcast_respects_bound(spark, size, fits):
    from cellpulse.session import bounded_broadcast
    df = spark.createDataFrame([("x" * 100,), (None,)], "s string")
    assert (bounded_broadcast(df, size) is not df) == fits
    assert bounded_broadcast(df, 10, known_bytes=11) is df


def test_prediction_sink_round_trip(spark):
    path = scratch_path(spark, "t-pred")
    df = spark.createDataFrame([(5, 1), (6, 0), (7, None)], "user_id bigint, prediction int")
    io.write_predictions(df, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["5,1", "6,0", "7,"]
    assert rows(io.read_predictions(spark, path), "user_id") == [(5, 1), (6, 0), (7, None)]


def test_array_to_columns_inverts_array(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    back = df.select(F.array("a", "b", "c").alias("v")).select(*text.array_to_columns("v", ["a", "b", "c"]))
    assert rows(back) == rows(df)


def test_device_log_header_dropped_by_content(spark):
    path = scratch_path(spark, "t-hdr")
    os.makedirs(local_path(path))
    with open(f"{local_path(path)}/a.csv", "w") as f:
        f.write('"201501","abc","3G"\n"MONTH","IMSI","NET"\n"201502","def","4G"\n')
    df = io.read_device_logs(spark, path, schema="month string, imsi string, net string",
                             header=False, header_text="IMSI", header_col="imsi")
    assert rows(df, "month") == [("201501", "abc", "3G"), ("201502", "def", "4G")]


def test_category_index_across_many_partitions(spark):
    vals = spark.range(1000).selectExpr("format_string('v%04d', cast((id * 7919) % 1000 as int)) as v")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")   # keep several range partitions for the tiny input
    try:
        idx = features.category_index(vals.repartition(7), ["v"]).drop("column")
        got = rows(idx, "value")
        parts = {r._p for r in idx.select(F.spark_partition_id().alias("_p")).collect()}
    finally:
        spark.conf.set(key, "true")
    assert got == [(f"v{i:04d}", i) for i in range(1000)]
    assert len(parts) > 1


def test_centres_numbered_across_several_files_in_name_order(spark):
    root = scratch_path(spark, "t-cent-files")
    area = f"{local_path(root)}/area=07"
    os.makedirs(area)
    with open(f"{area}/part-b.csv", "w") as f:           # bigger file, read second by name
        f.write("3.0,3.0\n4.0,4.0\n5.0,5.0\n")
    with open(f"{area}/part-a.csv", "w") as f:
        f.write("1.0,1.0\n2.0,2.0\n")
    got = rows(io.read_centres(spark, root), "clusterid")
    assert got == [(7, i, float(i + 1), float(i + 1)) for i in range(5)]


def test_scale_conf_sizes_partitions_from_input():
    from cellpulse.session import scale_conf
    conf = scale_conf(100 * 10**12)
    splits = 100 * 10**12 / int(conf["spark.sql.files.maxPartitionBytes"])
    assert splits * int(conf["spark.sql.shuffle.partitions"]) < 10**9   # blocks the driver keeps track of
    assert scale_conf(10)["spark.sql.shuffle.partitions"] == "8"
    assert scale_conf(10)["spark.sql.files.maxPartitionBytes"] == str(128 << 20)


def test_hash_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None,), (1,), (None,)], "k int")
    out = model.holdout_split(df, F.col("k"))
    assert out.where(F.col("split").isNull()).count() == 0 and out.count() == 3


def test_device_log_gbk_encoding(spark):
    path = scratch_path(spark, "t-gbk")
    os.makedirs(local_path(path))
    with open(f"{local_path(path)}/a.csv", "wb") as f:
        f.write('"month","imsi","vendor"\n"201512","abc","华为"\n'.encode("gbk"))
    key = "spark.sql.legacy.javaCharsets"
    spark.conf.set(key, "true")
    try:
        df = io.read_device_logs(spark, path, schema="month int, imsi string, vendor string",
                                 encoding="GBK")
        assert rows(df) == [(201512, "abc", "华为")]
    finally:
        spark.conf.unset(key)


def test_periods_run_on_across_months(spark):
    from cellpulse.plans.fixtures import in_periods, with_period
    days = spark.sql("select cast(d as timestamp_ntz) as ts from (select explode(sequence("
                     "date '2023-12-30', date '2024-03-05')) as d)")
    got = with_period(days)
    by_day = {str(r.ts.date()): r.period for r in got.collect()}
    assert by_day["2024-01-01"] == 1 and by_day["2024-01-30"] == 12 and by_day["2024-01-31"] == 13
    assert by_day["2024-02-01"] == 13 and by_day["2024-03-01"] == 25 and by_day["2023-12-31"] == 0
    for first, last in ((1, 1), (3, 4), (12, 12), (13, 14)):
        want = got.where(F.col("period").between(first, last))
        assert rows(with_period(in_periods(days, first, last)), "ts") == rows(want, "ts")


def test_read_located_takes_whatever_areas_there_are(spark):
    schema = io.LOCATED_SCHEMA
    df = spark.createDataFrame([(1, None, 1, 2.0, 3.0, 0, 4), (2, None, 1, 2.0, 3.0, 17, 4)], schema)
    root = scratch_path(spark, "t-areas")
    io.write_located_by_area(df, root)
    assert rows(io.read_located(spark, root), "user_id") == rows(df, "user_id")
    assert [r.user_id for r in io.read_located(spark, root, area=17).collect()] == [2]
    assert io.read_located(spark, root, area=3).count() == 0
    none = scratch_path(spark, "t-areas-none")
    io.write_located_by_area(df.where("user_id > 5"), none)
    assert io.read_located(spark, none).count() == 0
