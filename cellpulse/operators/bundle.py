"""A trained forest with all that it needs to score another month.

The folder of a bundle holds the model, the dictionary version and arities
it was trained with, and the order of its features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import is_whole, read_note, write_note
from . import features, model
from .dictionary import CategoryDictionary


class Bundle(NamedTuple):
    model: RandomForestClassificationModel
    version: int
    arity: dict[str, int]
    categorical: list[str]
    numeric: list[str]


def save(fitted: RandomForestClassificationModel, path: str, version: int, arity: Mapping[str, int],
         categorical: Sequence[str], numeric: Sequence[str], spark: SparkSession) -> None:
    """The note is written last: a bundle without it is not there."""
    fitted.write().overwrite().save(f"{path}/model")
    write_note(spark, f"{path}/note", {"version": version, "arity": dict(arity), "categorical": list(categorical),
                                       "numeric": list(numeric)})


def load(spark: SparkSession, path: str) -> Bundle:
    if not is_whole(spark, f"{path}/note"):
        raise FileNotFoundError(f"no whole bundle in {path}")
    note = read_note(spark, f"{path}/note")
    return Bundle(RandomForestClassificationModel.load(f"{path}/model"), note["version"], note["arity"],
                  note["categorical"], note["numeric"])


def score_rows(bundle: Bundle, rows: DataFrame, dictionary: CategoryDictionary, keep: Sequence[str]) -> DataFrame:
    """Predictions for ``rows`` (raw categories and numbers).

    Categories are read as of the bundle's version: a value that came later is
    *unknown* to the model, as null is, and every older one has the index it
    was trained with, however far the dictionary has grown.
    """
    index = dictionary.read(bundle.version).select("column", "value", "idx")
    ready = features.feature_rows(rows, index, bundle.categorical, bundle.numeric, keep=keep)
    return model.score(bundle.model, model.assembled(ready, bundle.categorical, bundle.numeric, bundle.arity), keep)
