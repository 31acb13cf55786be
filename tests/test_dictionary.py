"""A dictionary and a model that outlive their run."""

import subprocess
import sys

import pytest

from cellpulse.operators import bundle, features, model
from cellpulse.operators.dictionary import CategoryDictionary
from cellpulse.session import materialize, scratch_path
from cellpulse.sources.folders import Published
from conftest import ROOT

COLS = ["a", "b"]


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b int")


def values(frame):
    return {(r["column"], r["value"]): r["idx"] for r in frame.collect()}


def test_old_indices_stay_and_new_values_follow(spark):
    known = CategoryDictionary(spark, scratch_path(spark, "t-dictionary"))
    assert known.version == 0 and known.read().count() == 0
    assert known.grow(rows(spark, [("m", 5), ("k", 7), (None, None), ("m", 5)]), COLS) == 1
    first = values(known.read())
    assert first == {("a", "k"): 0, ("a", "m"): 1, ("b", "5"): 0, ("b", "7"): 1}
    assert known.grow(rows(spark, [("m", 5)]), COLS) == 1  # nothing new
    assert known.grow(rows(spark, [("l", 1), ("a", 5), ("k", 9), ("z", None)]), COLS) == 2
    assert values(known.read()) == {**first, ("a", "a"): 2, ("a", "l"): 3, ("a", "z"): 4, ("b", "1"): 2, ("b", "9"): 3}
    assert values(known.read(1)) == first
    assert known.grow(rows(spark, [("q", 1)]), [*COLS]) == 3 and values(known.read())["a", "q"] == 5


def test_a_column_of_its_own_later(spark):
    known = CategoryDictionary(spark, scratch_path(spark, "t-dictionary"))
    known.grow(rows(spark, [("x", 1)]), ["a"])
    known.grow(rows(spark, [("x", 1), ("w", 0)]), COLS)
    assert values(known.read()) == {("a", "x"): 0, ("a", "w"): 1, ("b", "0"): 0, ("b", "1"): 1}


def test_a_half_written_version_is_not_read(spark):
    root = scratch_path(spark, "t-dictionary")
    known = CategoryDictionary(spark, root)
    known.grow(rows(spark, [("x", 1)]), COLS)
    broken = known.states.path(2)
    spark.range(3).write.parquet(broken)
    from cellpulse.sources.folders import DONE, remove
    remove(spark, f"{broken}/{DONE}")
    assert CategoryDictionary(spark, root).version == 1
    assert known.grow(rows(spark, [("y", 1)]), COLS) == 3
    assert values(known.read()) == {("a", "x"): 0, ("a", "y"): 1, ("b", "1"): 0}


def training(spark):
    return spark.createDataFrame([(i, v, n, int(v == "b" or n > 5)) for i, (v, n) in enumerate(
        (v, n) for v in "abc" for n in range(12) for _ in range(3))], "k int, v string, x int, label int")


def test_saved_model_scores_after_the_dictionary_has_grown(spark):
    """In a session of its own, with values that sort before the known ones."""
    root = scratch_path(spark, "t-bundle")
    train = training(spark)
    known = CategoryDictionary(spark, f"{root}/dictionary")
    version = known.grow(train, ["v"])
    index = materialize(known.read(version).select("column", "value", "idx"))
    arity = features.arities(index, ["v"])
    ready = model.assembled(features.feature_rows(train, index, ["v"], ["x"], keep=["k", "label"]), ["v"], ["x"], arity)
    fitted = model.fit_forest(ready, numTrees=5, maxDepth=5, seed=1, featureSubsetStrategy="all")
    bundle.save(fitted, f"{root}/model", version, arity, ["v"], ["x"], spark)
    before = sorted(map(tuple, bundle.score_rows(bundle.load(spark, f"{root}/model"), train, known, ["k"]).collect()))
    assert before == [(r.k, r.label) for r in train.orderBy("k").collect()]
    known.grow(spark.createDataFrame([("0",), ("aa",)], "v string"), ["v"])
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from cellpulse.session import build_session
from cellpulse.operators import bundle
from cellpulse.operators.dictionary import CategoryDictionary
spark = build_session("local[2]", shuffle_partitions=2)
rows = spark.createDataFrame({[tuple(r) for r in train.collect()]!r} + [(900, "0", 9, 0), (901, None, 1, 0)], "k int, v string, x int, label int")
known = CategoryDictionary(spark, {root!r} + "/dictionary")
assert known.version == 2
found = bundle.score_rows(bundle.load(spark, {root!r} + "/model"), rows, known, ["k"]).collect()
print("FOUND", sorted(map(tuple, found)))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    found = eval(said.stdout.split("FOUND ")[1])
    assert found[:-2] == before and [k for k, _ in found[-2:]] == [900, 901]
    assert dict(found)[900] == 1  # unknown category, decided by its number


def test_a_bundle_without_its_note_is_not_there(spark):
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, scratch_path(spark, "t-none"))


def test_a_refused_or_failed_state_leaves_the_old_one(spark):
    states = Published(spark, scratch_path(spark, "t-published"))
    with pytest.raises(FileNotFoundError):
        states.read()
    states.publish(spark.range(5).write.parquet)
    with pytest.raises(ValueError):
        def refuse(path):
            raise ValueError(path)
        states.publish(spark.range(9).write.parquet, check=refuse)
    with pytest.raises(Exception):
        states.publish(spark.range(9).selectExpr("raise_error('midway') x").write.parquet)
    assert states.read().count() == 5 and states.versions() == [1]
    assert states.publish(spark.range(7).write.parquet, keep=1) == 2
    assert states.read().count() == 7 and states.versions() == [2]
