"""The forest keys beyond what their SQL states."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellpulse.constants import DEVICE_CATEGORICAL, DEVICE_NUMERIC
from cellpulse.plans import queries as Q
from cellpulse.plans.device import DeviceInputs
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def inputs(spark):
    return Q.ForestInputs(spark, SF_SMALL)


def test_forest_reads_seven_features_with_their_arities(spark, inputs):
    part = inputs.part("train")
    assert len(part.first().features) == 7 == len(DEVICE_CATEGORICAL) + len(DEVICE_NUMERIC)
    attrs = part.schema["features"].metadata["ml_attr"]["attrs"]
    assert {a["name"]: len(a["vals"]) for a in attrs["nominal"]} == {f"{c}_idx": n for c, n in inputs.arity.items()}
    assert [a["name"] for a in attrs["numeric"]] == DEVICE_NUMERIC


def test_no_labelled_row_is_lost(spark, inputs):
    d = DeviceInputs(spark, SF_SMALL)
    assert inputs.rows.count() == d.labeled.count()
    assert inputs.rows.where("voice = -1").count() == d.labeled.where("voice is null").count() > 0


def test_every_target_with_a_record_gets_one_prediction(spark):
    got = entry.queries()["predict_target"](spark, SF_SMALL)
    targets = DeviceInputs(spark, SF_SMALL).targets
    assert got.count() == got.select("user_id").distinct().count() > 0
    assert got.join(targets, "user_id", "left_anti").count() == 0
    assert got.where(~F.col("prediction").isin(0, 1)).count() == 0
