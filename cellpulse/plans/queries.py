"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (through the derivations in
``fixtures``) and runs over them whole. Round-trip queries write to a fresh
folder under the shared checkpoint directory and return the frame read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import (CATEGORY_COLUMNS, CV_FOLDS, DEVICE_CATEGORICAL, DEVICE_FIELDS, DEVICE_NUMERIC,
                         FOREST_GRID, FOREST_PARAMS, LAST_PERIOD, PROFILE_COLUMNS)
from ..functions import text
from ..operators import bundle, change, dictionary, features, model, quality
from ..operators import profile as prof_op
from ..operators import spatial as spatial_op
from ..session import materialize, scratch_path
from ..sources import csv as io
from ..sources import rejects
from ..sources.tables import read_table
from . import fixtures
from .device import DeviceInputs
from .monthly import MonthStore
from .profile import ProfileInputs
from .spatial import SpatialInputs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CATEGORICAL = DEVICE_CATEGORICAL
NUMERIC = DEVICE_NUMERIC
#: The SQL report covers one day, hour, area and cluster.
REPORT_DATE, REPORT_HOUR, REPORT_AREA, REPORT_CLUSTER = "2024-01-17", 12, 0, 5


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# --- device -----------------------------------------------------------------

@register("period_snapshot")
def period_snapshot(spark, sf_dir):
    return DeviceInputs(spark, sf_dir).snap


@register("target_list")
def target_list(spark, sf_dir):
    """The target list as the analysis gets it: a text file of ids, read back."""
    path = scratch_path(spark, "targets")
    io.write_ids(DeviceInputs(spark, sf_dir).targets, path)
    return io.read_ids(spark, path)


def _last_two(spark, sf_dir) -> DeviceInputs:
    """The last period and the one before it: what a one-period question reads."""
    return DeviceInputs(spark, sf_dir, reuse=True, periods=(LAST_PERIOD - 1, LAST_PERIOD))


@register("device_switch")
def device_switch(spark, sf_dir):
    return DeviceInputs(spark, sf_dir, reuse=True).switch


@register("switch_one_period")
def switch_one_period(spark, sf_dir):
    return _last_two(spark, sf_dir).switch


@register("switch_counts")
def switch_counts(spark, sf_dir):
    return change.counts_per_period(DeviceInputs(spark, sf_dir, reuse=True).switch)


@register("label_prev_period")
def label_prev_period(spark, sf_dir):
    return DeviceInputs(spark, sf_dir, reuse=True).labeled


@register("label_one_period")
def label_one_period(spark, sf_dir):
    return _last_two(spark, sf_dir).labeled


def _months(spark, sf_dir) -> MonthStore:
    """A store that got the last two months one after the other, each from its own events."""
    root = scratch_path(spark, "months")
    for month in (LAST_PERIOD - 1, LAST_PERIOD):
        store = MonthStore(spark, root)
        store.append(month, DeviceInputs(spark, sf_dir, periods=(month, month)).snap)
    return MonthStore(spark, root)


@register("month_switch")
def month_switch(spark, sf_dir):
    """The change set of a newly added month."""
    return _months(spark, sf_dir).changes_of(LAST_PERIOD, DeviceInputs(spark, sf_dir).targets)


@register("month_label")
def month_label(spark, sf_dir):
    """The labels of a newly added month."""
    return _months(spark, sf_dir).labels_of(LAST_PERIOD, DeviceInputs(spark, sf_dir).targets)


@register("target_scoring_rows")
def target_scoring_rows(spark, sf_dir):
    return _scoring_rows(spark, sf_dir)


def _scoring_rows(spark, sf_dir) -> DataFrame:
    d = DeviceInputs(spark, sf_dir, periods=(LAST_PERIOD, LAST_PERIOD))
    return change.rows_in_period(d.snap, d.targets, LAST_PERIOD).select(*DEVICE_FIELDS)


@register("label_counts")
def label_counts(spark, sf_dir):
    return DeviceInputs(spark, sf_dir, reuse=True).labeled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- features ---------------------------------------------------------------

@register("category_distinct")
def category_distinct(spark, sf_dir):
    """Distinct values of all seven text columns of the device record."""
    return features.distinct_values(DeviceInputs(spark, sf_dir).snap, CATEGORY_COLUMNS)


@register("category_index")
def category_index(spark, sf_dir):
    return features.category_index(DeviceInputs(spark, sf_dir).snap, CATEGORY_COLUMNS)


@register("feature_rows")
def feature_rows(spark, sf_dir):
    d = DeviceInputs(spark, sf_dir, reuse=True)
    return features.feature_rows(d.labeled, materialize(features.category_index(d.snap, CATEGORICAL)), CATEGORICAL, NUMERIC)


# --- profile ----------------------------------------------------------------

@register("profile_sum")
def profile_sum(spark, sf_dir):
    return ProfileInputs(spark, sf_dir).prof


@register("l2_normalize")
def l2_normalize(spark, sf_dir):
    return ProfileInputs(spark, sf_dir).norm


@register("tag_thresholds")
def tag_thresholds(spark, sf_dir):
    return ProfileInputs(spark, sf_dir).thresholds


@register("feature_histogram")
def feature_histogram(spark, sf_dir):
    return prof_op.histogram(ProfileInputs(spark, sf_dir, reuse=True).norm, PROFILE_COLUMNS)


@register("tag_flags")
def tag_flags(spark, sf_dir):
    return ProfileInputs(spark, sf_dir, reuse=True).tags


@register("tag_sum")
def tag_sum(spark, sf_dir):
    """Tag rows stored twice per user are re-aggregated to one row per user."""
    tags = ProfileInputs(spark, sf_dir, reuse=True).tags
    return prof_op.sum_by_key(tags.unionByName(tags), "user_id", PROFILE_COLUMNS)


@register("profile_as_array")
def profile_as_array(spark, sf_dir):
    """Record -> 20-element array -> record, every position named ``arr_<i>``."""
    arr = F.array(*PROFILE_COLUMNS)
    names = [f"arr_{i}" for i in range(len(PROFILE_COLUMNS))]
    rows = ProfileInputs(spark, sf_dir).prof.select("user_id", arr.alias("v"))
    return rows.select("user_id", *text.array_to_columns("v", names), F.size("v").alias("arr_size"))


# --- spatial ----------------------------------------------------------------

@register("unpivot_hours")
def unpivot_hours(spark, sf_dir):
    return SpatialInputs(spark, sf_dir).long


@register("area_assign")
def area_assign(spark, sf_dir):
    return SpatialInputs(spark, sf_dir).area


@register("nearest_centre")
def nearest_centre(spark, sf_dir):
    return SpatialInputs(spark, sf_dir).clus


@register("nearest_of_many")
def nearest_of_many(spark, sf_dir):
    """Each located record and the nearest of many centres: the points seen on one day, numbered per area."""
    located = materialize(SpatialInputs(spark, sf_dir).area)
    seen = located.where(F.col("dt") == F.lit("2024-01-05").cast("date")).select("areaid", F.col("x").alias("cx"), F.col("y").alias("cy")).distinct()
    # The points of an area are a grid of fixed steps, so their number is bounded.
    number = F.row_number().over(Window.partitionBy("areaid").orderBy("cx", "cy")) - 1
    return spatial_op.nearest_of_many(located, materialize(seen.withColumn("clusterid", number.cast("int"))))


@register("cluster_centres")
def cluster_centres(spark, sf_dir):
    """Centres stored in the model format (an x,y file per area) and read
    back, each with the number of located points it is nearest to."""
    s = SpatialInputs(spark, sf_dir)
    root = scratch_path(spark, "centres")
    io.write_centres(s.centres, root)
    cent = io.read_centres(spark, root)
    members = s.clus.groupBy("areaid", "clusterid").agg(F.count(F.lit(1)).alias("n"))
    return (cent.join(members, ["areaid", "clusterid"], "left")
                .select("areaid", "clusterid", "cx", "cy",
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


@register("located_with_tags")
def located_with_tags(spark, sf_dir):
    """All located records with the tags of their user; users off the target list have none."""
    located = materialize(SpatialInputs(spark, sf_dir).clus)
    return spatial_op.located_with_tags(located, _target_tags(spark, sf_dir), hot=spatial_op.hot_keys(located, "user_id"))


def _target_tags(spark, sf_dir) -> DataFrame:
    targets = DeviceInputs(spark, sf_dir).targets
    return ProfileInputs(spark, sf_dir, reuse=True).tags.join(targets, "user_id", "left_semi")


@register("sql_report_filter")
def sql_report_filter(spark, sf_dir):
    """The report as SQL text over named views, for one day, hour, area and cluster."""
    tag = uuid.uuid4().hex[:8]
    loc, tg = f"located_{tag}", f"usertag_{tag}"
    SpatialInputs(spark, sf_dir, hour=REPORT_HOUR).clus.createOrReplaceTempView(loc)
    _target_tags(spark, sf_dir).createOrReplaceTempView(tg)
    fcols = ", ".join(f"u.{c}" for c in PROFILE_COLUMNS)
    report = spark.sql(f"""
        select s.user_id, s.dt, s.hr, s.x, s.y, s.areaid, s.clusterid,
               u.user_id as tag_user_id, {fcols}
        from {loc} s left outer join {tg} u on s.user_id = u.user_id
        where s.dt = date '{REPORT_DATE}' and s.hr = {REPORT_HOUR}
          and s.areaid = {REPORT_AREA} and s.clusterid = {REPORT_CLUSTER}""")
    # The report's plan is resolved; the names are no longer needed.
    for name in (loc, tg):
        spark.catalog.dropTempView(name)
    return report


@register("where_date")
def where_date(spark, sf_dir):
    return SpatialInputs(spark, sf_dir).long.where(F.col("dt") == F.lit("2024-01-05").cast("date"))


@register("row_count")
def row_count(spark, sf_dir):
    return quality.row_count(SpatialInputs(spark, sf_dir).long)


@register("top_rows")
def top_rows(spark, sf_dir):
    """A preview: the first ten located records in key order (top-k, not a full sort)."""
    return SpatialInputs(spark, sf_dir).clus.orderBy("user_id", "dt", "hr").limit(10)


# --- quality ----------------------------------------------------------------

@register("distinct_users")
def distinct_users(spark, sf_dir):
    return quality.distinct_count(read_table(spark, sf_dir, "events"), "user_id")


@register("distinct_by_period")
def distinct_by_period(spark, sf_dir):
    """Users per period and in all (period 0): exact, and whether stored and merged sketches come within 3 %."""
    ev = fixtures.with_period(read_table(spark, sf_dir, "events")).select("period", "user_id")
    path = scratch_path(spark, "sketches")
    quality.distinct_sketches(ev, "period", "user_id").write.parquet(path)
    sketches = spark.read.parquet(path)
    exact = ev.cube("period").agg(F.count_distinct("user_id").alias("n"))
    exact = exact.select(F.coalesce("period", F.lit(0)).alias("period"), "n")
    estimates = quality.merged_distinct(sketches, "period").unionByName(
        quality.merged_distinct(sketches).withColumn("period", F.lit(0)))
    close = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") * 0.03)
    return exact.join(estimates, "period").select("period", "n", close.alias("within_bound"))


@register("column_profile")
def column_profile(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return _rounded(quality.column_profile(ev.select(F.floor("value").cast("double").alias("value")), ["value"]))


def _rounded(profile: DataFrame) -> DataFrame:
    """Mean and deviation to six digits: engines add in different orders."""
    return profile.withColumns({c: F.round(c, 6) for c in ("mean", "stdev")})


def device_lines(events: DataFrame) -> DataFrame:
    """Quoted 11-field device-log lines; the model field holds commas on some rows."""
    model_name = ("case when event_id % 7 = 0 then concat_ws(',', event_type, upper(event_type), "
                  "'X5') else event_type end")
    fields = ["event_id", "user_id", "event_type", "cast(floor(value / 100) as int)",
              "cast(floor(value) as int)", "cast(event_id % 100 as int)", model_name, "hour(ts)",
              "day(ts)", "length(props)", "event_id % 2"]
    inner = ", ".join(f"cast({f} as string)" for f in fields)
    return events.selectExpr(f"""concat('"', concat_ws('","', {inner}), '"') as line""")


@register("field_count_profile")
def field_count_profile(spark, sf_dir):
    lines = device_lines(read_table(spark, sf_dir, "events"))
    return _rounded(quality.field_count_profile(lines, "line", [",", '","']))


# --- model ------------------------------------------------------------------

@register("kfold_assign")
def kfold_assign(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id")
    return model.kfold_assign(ev, "event_id", CV_FOLDS)


@register("holdout_split")
def holdout_split(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id")
    return (model.holdout_split(ev, F.col("event_id"), (8, 1))
                 .groupBy("split").agg(F.count(F.lit(1)).alias("n")))


def _conf(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    return model.confusion(labels, label="quality", prediction="toxic")


@register("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return _conf(spark, sf_dir)


@register("classification_metrics")
def classification_metrics(spark, sf_dir):
    return model.binary_metrics(_conf(spark, sf_dir))


def _row_key() -> Column:
    return F.concat_ws("-", F.col("user_id"), F.col("period"))


class ForestInputs:
    """The labelled feature rows, indexed and assembled once, split into folds and hold-out.

    The rows and the index are materialised: training, hold-out and scoring
    read them instead of deriving them again.
    """

    def __init__(self, spark, sf_dir, device: DeviceInputs | None = None, index: DataFrame | None = None):
        d = device or DeviceInputs(spark, sf_dir, reuse=True)
        self.index = materialize(features.category_index(d.snap, CATEGORICAL)) if index is None else index
        self.arity = features.arities(self.index, CATEGORICAL)
        rows = features.feature_rows(d.labeled, self.index, CATEGORICAL, NUMERIC)
        rows = model.holdout_split(rows, _row_key(), (8, 1)).withColumn("fold", model.hash_bucket(_row_key(), CV_FOLDS))
        self.rows = materialize(rows)

    def part(self, name: str, label: Column | None = None) -> DataFrame:
        """One side of the split, with another label if given."""
        rows = self.rows.where(F.col("split") == name)
        rows = rows if label is None else rows.withColumn("label", label)
        return model.assembled(rows, CATEGORICAL, NUMERIC, self.arity)

    def fit(self, train: DataFrame | None = None, **params):
        return model.fit_forest(self.part("train") if train is None else train, **{**FOREST_PARAMS, **params})


def _easy_label() -> Column:
    """A label that the features decide: 3G, or many messages. A right forest must get every row."""
    return ((F.col("net_idx") == 1) | (F.col("sms") >= 50)).cast("int")


@register("rf_fit_predict")
def rf_fit_predict(spark, sf_dir):
    """Train on the 8/9 split and score the 1/9 hold-out, on the change label and on one that the features decide.

    Returns per label and actual class the hold-out rows scored and, for the
    label that a forest must get, how many it got.
    """
    f = ForestInputs(spark, sf_dir)
    out = []
    for name in ("change", "decided"):
        easy = name == "decided"
        train, holdout = (f.part(part, _easy_label() if easy else None) for part in ("train", "holdout"))
        # All features at every split where every row must be right: no luck of the draw.
        fitted = model.fit_forest(train, **{**FOREST_PARAMS, **({"featureSubsetStrategy": "all"} if easy else {})})
        counts = model.confusion(model.score(fitted, holdout, ["label"]), classes=[0, 1])
        right = F.when(F.col("label") == 0, F.col("pred_0")).otherwise(F.col("pred_1"))
        out.append(counts.select(F.lit(name).alias("kind"), "label", (F.col("pred_0") + F.col("pred_1")).alias("n"),
                                 (right if easy else F.lit(None).cast("bigint")).alias("n_right")))
    return out[0].unionByName(out[1])


@register("rf_separable")
def rf_separable(spark, sf_dir):
    """The same forest on a label that its features decide: its confusion matrix on the hold-out."""
    f = ForestInputs(spark, sf_dir)
    train, holdout = (f.part(part, _easy_label()) for part in ("train", "holdout"))
    # All features at every split: the label must not depend on which are drawn.
    fitted = model.fit_forest(train, **{**FOREST_PARAMS, "featureSubsetStrategy": "all"})
    return model.confusion(model.score(fitted, holdout, ["label"]), classes=[0, 1])


@register("rf_grid_cv")
def rf_grid_cv(spark, sf_dir):
    """Grid points x folds, each with its sizes and the figures of its confusion matrix.

    The label is 3G or gender F, categories that every fold's forest must get
    right; the fits are kept in a store as they end.
    """
    f = ForestInputs(spark, sf_dir)
    rows = f.part("train", ((F.col("net_idx") == 1) | (F.col("gender_idx") == 0)).cast("int"))
    found = model.forest_grid_cv(rows, {**FOREST_GRID, "featureSubsetStrategy": ["all"]}, CV_FOLDS,
                                 store=scratch_path(spark, "grid"))
    return model.grid_table(spark, found).select(
        *FOREST_GRID, "fold", "n_train", "n_valid", "accuracy", "f_measure", "precision", "recall")


@register("predict_target")
def predict_target(spark, sf_dir):
    """A forest saved with its dictionary, read back after the dictionary has grown, scores each
    target's last-period record; the predictions go through the text sink and are read back.

    The label is one that the features decide, so that every prediction is known.
    """
    d = DeviceInputs(spark, sf_dir, reuse=True)
    known = dictionary.CategoryDictionary(spark, scratch_path(spark, "dictionary"))
    version = known.grow(d.snap, CATEGORICAL)
    f = ForestInputs(spark, sf_dir, d, known.read(version).select("column", "value", "idx"))
    path = scratch_path(spark, "bundle")
    fitted = f.fit(f.part("train", _easy_label()), featureSubsetStrategy="all")
    bundle.save(fitted, path, version, f.arity, CATEGORICAL, NUMERIC, spark)
    # Values of a later month, which sort before and after the known ones.
    known.grow(d.snap.withColumns({c: F.concat(F.lit("0"), c) for c in CATEGORICAL}), CATEGORICAL)
    scored = bundle.score_rows(bundle.load(spark, path), _scoring_rows(spark, sf_dir), known, ["user_id"])
    out = scratch_path(spark, "predictions")
    io.write_predictions(scored, out)
    return io.read_predictions(spark, out).select("user_id", "prediction")


@register("dictionary_growth")
def dictionary_growth(spark, sf_dir):
    """The dictionary of the first period, grown by all others: old indices stay, new values follow."""
    snap = DeviceInputs(spark, sf_dir, reuse=True).snap.withColumn("handset", F.concat_ws("/", "dtype", "bytes", "age"))
    known = dictionary.CategoryDictionary(spark, scratch_path(spark, "dictionary"))
    cols = [*CATEGORY_COLUMNS, "handset"]
    known.grow(snap.where(F.col("period") == 1), cols)
    known.grow(snap, cols)
    return known.read().select("column", "value", "idx")


# --- sources and sinks (write, read back) -------------------------------------

@register("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """Device logs as quoted CSV, a header per file, a folder per period, a
    comma inside the model field; one read of all periods, all eleven fields typed."""
    snap = DeviceInputs(spark, sf_dir).snap
    path = scratch_path(spark, "device")
    io.write_device_logs(snap.withColumn("dtype", F.concat_ws(",", "dtype", F.upper("vendor"))),
                         path, partition_by="period")
    return io.read_device_logs(spark, path)


@register("reject_report")
def reject_report(spark, sf_dir):
    """Device rows as text, some with a word or a letter in a number field: the bad tokens and the rows that are left."""
    path = scratch_path(spark, "dirty")
    rows = read_table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("x"), F.floor("value"))).otherwise(F.floor("value").cast("string")).alias("voice"),
        F.when(F.col("event_id") % 89 == 0, "none").when(F.col("event_id") % 7 == 0, None)
         .otherwise((F.col("event_id") % 100).cast("string")).alias("sms"))
    rows.write.option("header", True).csv(path)
    found = rejects.read_checked(spark, path, "event_id bigint, event_type string, voice int, sms int", most=0.05, header=True)
    bad = found.rejects.groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"))
    # The rows that went on, by the sum of their typed numbers.
    kept = found.rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("voice") + F.coalesce("sms", F.lit(0))).cast("string").alias("token"))
    return bad.unionByName(kept.select(F.lit("kept").alias("field"), "token", "n"))


@register("wide_scan_fill")
def wide_scan_fill(spark, sf_dir):
    """Wide rows as ragged text (a row ends with its last point, inner gaps are empty), read back and filled."""
    wide = SpatialInputs(spark, sf_dir).wide
    path = scratch_path(spark, "wide")
    io.write_ragged_locations(wide, path)
    return io.read_wide_locations(spark, path)


@register("profile_project_fill")
def profile_project_fill(spark, sf_dir):
    """Raw 24-column usage lines with quotes, blanks for zeros and a header row; read back with
    the header and columns 6, 7 and 22 dropped and blanks filled; summed per user."""
    path = scratch_path(spark, "profile")
    io.write_raw(fixtures.usage_lines(read_table(spark, sf_dir, "events")), path)
    return prof_op.sum_by_key(io.read_profiles(spark, path, header_text="IMEI"), "user_id", PROFILE_COLUMNS)


@register("tag_roundtrip")
def tag_roundtrip(spark, sf_dir):
    tags = ProfileInputs(spark, sf_dir, reuse=True).tags
    path = scratch_path(spark, "tags")
    io.write_tags(tags, path)
    return io.read_tags(spark, path)


@register("multi_path_union")
def multi_path_union(spark, sf_dir):
    clus = SpatialInputs(spark, sf_dir).clus
    root = scratch_path(spark, "located")
    io.write_located_by_area(clus, root)
    return io.read_located(spark, root)


# --- scalar functions -------------------------------------------------------

@register("record_to_line")
def record_to_line(spark, sf_dir):
    """The five line formats: target id, device record, usage record, located record, tag record."""
    d = DeviceInputs(spark, sf_dir, periods=(LAST_PERIOD, LAST_PERIOD))
    p, s = ProfileInputs(spark, sf_dir, reuse=True), SpatialInputs(spark, sf_dir)
    whole = [F.col(c).cast("bigint") for c in PROFILE_COLUMNS]
    lines = [
        d.targets.select(F.lit("target").alias("kind"), text.to_line(["user_id"]).alias("line")),
        # A target without a record keeps its fields, all but the id empty.
        d.targets.join(d.snap.where(F.col("period") == LAST_PERIOD), "user_id", "left")
         .select(F.lit("device").alias("kind"), text.to_line(DEVICE_FIELDS).alias("line")),
        p.prof.select(F.lit("usage").alias("kind"), text.to_line(["user_id", *whole]).alias("line")),
        s.clus.select(F.lit("located").alias("kind"), text.to_line(
            ["user_id", "dt", "hr", "areaid", "clusterid"]).alias("line")),
        p.tags.select(F.lit("tag").alias("kind"), text.to_line(["user_id", *PROFILE_COLUMNS]).alias("line")),
    ]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


@register("hex_to_decimal")
def hex_to_decimal(spark, sf_dir):
    clus = SpatialInputs(spark, sf_dir).clus
    return clus.select(text.hex_to_decimal(F.md5(F.col("user_id").cast("string")))
                       .alias("user_dec"), "dt", "hr", "x", "y", "areaid", "clusterid")


@register("bytes_to_hex")
def bytes_to_hex(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", text.bytes_to_hex("event_type").alias("hex"),
                     text.bytes_to_hex("event_type", ":").alias("hex_sep"))


@register("strip_quotes")
def strip_quotes(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    stripped = text.strip_quotes(quoted)
    return ev.select("event_id", quoted.alias("quoted"), stripped.alias("stripped"),
                     quoted.contains('"').alias("quoted_has_quote"),
                     stripped.contains('"').alias("stripped_has_quote"))


@register("zero_pad")
def zero_pad(spark, sf_dir):
    snap = DeviceInputs(spark, sf_dir).snap
    padded = text.zero_pad("period", 2)
    return snap.select("user_id", "period", padded.alias("period_str"),
                       F.concat(F.lit("device"), padded).alias("table_name"))
