"""Splits, random forest training / cross-validation / scoring, and metrics.

Splits are hash-based on a key so that a rerun (or a recomputed partition
after losing an executor) puts every row in the same split; the original
used an unseeded ``randomSplit``. Training uses ``pyspark.ml`` on assembled
feature rows; a category's arity comes from the index table, not from a typed
list.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, materialize
from ..sources.folders import is_whole, read_note, write_note


def hash_bucket(key: Column, k: int) -> Column:
    """Stable bucket 0..k-1: first 8 hex digits of md5(key) as an integer, mod k.

    A null key hashes like the empty string, so every row gets a bucket.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (h % k).cast("int")


def kfold_assign(df: DataFrame, key: str, k: int = 3, fold_col: str = "fold") -> DataFrame:
    return df.withColumn(fold_col, hash_bucket(F.col(key), k))


def holdout_split(df: DataFrame, key: Column, weights: Sequence[int] = (8, 1),
                  names: Sequence[str] = ("train", "holdout"), split_col: str = "split") -> DataFrame:
    """Adds ``split``: buckets 0..sum(weights)-1 cut in order by ``weights``."""
    b = hash_bucket(key, sum(weights))
    label, start = None, 0
    for w, name in zip(weights, names):
        cond = b < start + w
        label = F.when(cond, name) if label is None else label.when(cond, name)
        start += w
    return df.withColumn(split_col, label)


def classes_of(df: DataFrame, label: str = "label", prediction: str = "prediction") -> list[int]:
    """Sorted classes that occur as a label or a prediction (a handful, not data-sized)."""
    both = df.select(F.explode(F.array(F.col(label).cast("int"), F.col(prediction).cast("int"))).alias("c"))
    return sorted(r["c"] for r in both.where("c is not null").distinct().collect())


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              classes: Sequence[int] | None = None) -> DataFrame:
    """k x k counts: a row per actual class, a column ``pred_<c>`` per predicted class.

    ``classes`` (default: all that occur on either side) fixes rows and
    columns; a class that never occurs as a label has a row of zeros. Rows
    with a null side are in no cell.
    """
    classes = classes_of(df, label, prediction) if classes is None else sorted(classes)
    spark = df.sparkSession
    rows = spark.createDataFrame([(c,) for c in classes], "label int")
    p = (df.select(F.col(label).cast("int").alias("label"),
                   F.col(prediction).cast("int").alias("prediction"))
           .groupBy("label").pivot("prediction", list(classes) or [0]).count())
    return rows.join(p, "label", "left").select(
        "label", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in classes])


def class_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class, and the overall accuracy (k rows)."""
    classes = [int(c.removeprefix("pred_")) for c in conf.columns if c.startswith("pred_")]
    total = sum((F.col(f"pred_{c}") for c in classes), F.lit(0))
    sums = conf.agg(*[F.sum(f"pred_{c}").alias(f"p{c}") for c in classes],
                    *[F.sum(F.when(F.col("label") == c, total).otherwise(0)).alias(f"a{c}") for c in classes],
                    *[F.sum(F.when(F.col("label") == c, F.col(f"pred_{c}")).otherwise(0)).alias(f"t{c}") for c in classes])
    hits = sum((F.col(f"t{c}") for c in classes), F.lit(0)).cast("double")
    everything = sum((F.col(f"a{c}") for c in classes), F.lit(0)).cast("double")
    each = []
    for c in classes:
        precision = F.try_divide(F.col(f"t{c}").cast("double"), F.col(f"p{c}").cast("double"))
        recall = F.try_divide(F.col(f"t{c}").cast("double"), F.col(f"a{c}").cast("double"))
        each.append(F.struct(
            F.lit(c).alias("label"), F.col(f"a{c}").alias("support"), precision.alias("precision"), recall.alias("recall"),
            F.try_divide(F.lit(2.0) * precision * recall, precision + recall).alias("f1"),
            F.try_divide(hits, everything).alias("accuracy")))
    return sums.select(F.explode(F.array(*each)).alias("m")).select("m.*")


def binary_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy; precision, recall and F1 of class 1; the majority-class share.

    ``conf`` is the 2 x 2 confusion frame; the result is one row. Class-1
    recall next to accuracy shows when a model only predicts the majority.
    """
    d = lambda c: F.col(c).cast("double")
    one = conf.agg(
        F.sum(F.when(F.col("label") == 1, d("pred_1")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("label") == 0, d("pred_1")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(F.col("label") == 1, d("pred_0")).otherwise(0.0)).alias("fn"),
        F.sum(F.when(F.col("label") == 0, d("pred_0")).otherwise(0.0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    return one.select(
        F.try_divide(tp + tn, total).alias("accuracy"),
        precision.alias("precision_1"), recall.alias("recall_1"),
        F.try_divide(F.lit(2.0) * precision * recall, precision + recall).alias("f1_1"),
        F.try_divide(F.greatest(tp + fn, fp + tn), total).alias("majority_share"))


def assembled(rows: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
              arity: Mapping[str, int]) -> DataFrame:
    """Adds ``features``: category indices (nominal, with their arity) and numbers, in this order.

    The rows must have no null feature (``features.feature_rows``).
    """
    out = rows
    for c in categorical:
        meta = {"ml_attr": {"name": f"{c}_idx", "type": "nominal", "vals": [str(i) for i in range(arity[c])]}}
        # The assembler reads a column's attribute from double columns only.
        out = out.withColumn(f"{c}_idx", F.col(f"{c}_idx").cast("double")).withMetadata(f"{c}_idx", meta)
    inputs = [f"{c}_idx" for c in categorical] + list(numeric)
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(out)


def fit_forest(rows: DataFrame, label: str = "label", **params) -> RandomForestClassificationModel:
    """Forest on ``label`` and ``features``; deep trees cache node ids and checkpoint
    them to the shared folder so a lost executor does not replay all levels."""
    checkpoint_root(rows.sparkSession)
    params.setdefault("cacheNodeIds", True)
    params.setdefault("checkpointInterval", 10)
    data = rows.select(F.col(label).cast("double").alias(label), "features").persist()
    try:
        return RandomForestClassifier(labelCol=label, featuresCol="features", **params).fit(data)
    finally:
        data.unpersist()


def score(model: RandomForestClassificationModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows and their predictions stay together (no zip of separate RDDs)."""
    return model.transform(rows).select(*keep, F.col("prediction").cast("int").alias("prediction"))


class FoldResult(NamedTuple):
    """One grid point on one fold: its settings, its model, and how that did on the fold.

    ``precision``, ``recall`` and ``f_measure`` are those of class 1, from the
    fold's own confusion matrix ``counts`` (actual, predicted, rows); null
    where there is nothing to divide by.
    """
    point: dict
    fold: int
    model: RandomForestClassificationModel
    n_train: int
    counts: list[tuple[int, int, int]]

    @property
    def n_valid(self) -> int:
        return sum(n for _, _, n in self.counts)

    def _share(self, hits, of) -> float | None:
        total = sum(n for a, p, n in self.counts if of(a, p))
        return sum(n for a, p, n in self.counts if of(a, p) and hits(a, p)) / total if total else None

    @property
    def accuracy(self) -> float | None:
        return self._share(lambda a, p: a == p, lambda a, p: True)

    @property
    def precision(self) -> float | None:
        return self._share(lambda a, p: a == 1, lambda a, p: p == 1)

    @property
    def recall(self) -> float | None:
        return self._share(lambda a, p: p == 1, lambda a, p: a == 1)

    @property
    def f_measure(self) -> float | None:
        p, r = self.precision, self.recall
        return 2 * p * r / (p + r) if p and r else (None if p is None or r is None else 0.0)


def fingerprint(data: DataFrame, cols: Sequence[str]) -> str:
    """Digest of a table's rows, whatever their order: their number and two sums of their hashes."""
    both = data.select(F.xxhash64(*cols).alias("a"), F.hash(*cols).alias("b"))
    found = both.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("long"))).first()
    return "-".join(str(v) for v in found)


def forest_grid_cv(rows: DataFrame, grid: Mapping[str, Sequence], folds: int, fold_col: str = "fold",
                   label: str = "label", parallelism: int = 3, seed: int = 1, store: str | None = None) -> list[FoldResult]:
    """Grid x k-fold search: a model and its validation figures per grid point and fold.

    Folds come from ``fold_col`` (a hash fold), so they are reproducible; fits
    run side by side; no model is fitted and thrown away. ``rows`` needs
    ``features``, ``label`` and ``fold_col`` only, and is computed once.

    With ``store``, each finished fit is kept there, model first and figures
    last, under a name made of its settings, fold, seed and the data's
    fingerprint. A search that was killed goes on with what is missing; other
    data or settings share nothing with it.
    """
    data = materialize(rows.select(F.col(label).cast("double").alias(label), fold_col, "features"))
    spark = data.sparkSession
    sizes = {r[fold_col]: r["n"] for r in data.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    mark = "" if store is None else fingerprint(
        data.withColumn("features", vector_to_array("features")), [label, fold_col, "features"])

    def place(point: dict, fold: int) -> str:
        name = json.dumps([sorted(point.items()), fold, folds, seed, label, mark], default=str)
        return f"{store}/{hashlib.sha256(name.encode()).hexdigest()[:24]}"

    def run(task: tuple[dict, int]) -> FoldResult:
        point, fold = task
        n_train = sum(n for f, n in sizes.items() if f != fold)
        if store is not None and is_whole(spark, f"{place(point, fold)}/figures"):
            note = read_note(spark, f"{place(point, fold)}/figures")
            return FoldResult(point, fold, RandomForestClassificationModel.load(f"{place(point, fold)}/model"),
                              note["n_train"], [tuple(c) for c in note["counts"]])
        model = fit_forest(data.where(F.col(fold_col) != fold), label, seed=seed, **point)
        scored = model.transform(data.where(F.col(fold_col) == fold))
        # At most classes x classes rows.
        counts = [(int(r[0]), int(r[1]), r[2]) for r in
                  scored.groupBy(label, "prediction").count().orderBy(label, "prediction").collect()]
        if store is not None:
            model.write().overwrite().save(f"{place(point, fold)}/model")
            write_note(spark, f"{place(point, fold)}/figures", {"point": point, "fold": fold, "n_train": n_train, "counts": counts})
        return FoldResult(point, fold, model, n_train, counts)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(run, itertools.product(points, range(folds))))


def grid_table(spark, results: Sequence[FoldResult]) -> DataFrame:
    """The figures of a grid search as a frame: a row per grid point and fold."""
    names = list(results[0].point) if results else []
    out = [tuple(r.point.values()) + (r.fold, r.n_train, r.n_valid, r.accuracy, r.f_measure, r.precision, r.recall) for r in results]
    kinds = [f"{n} {'string' if isinstance(results[0].point[n], str) else 'int'}" for n in names]
    return spark.createDataFrame(out, ", ".join(kinds + [
        "fold int", "n_train bigint", "n_valid bigint", "accuracy double", "f_measure double", "precision double", "recall double"]))
