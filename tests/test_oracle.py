"""Every query key against its DuckDB oracle at sf0.01 (rows-only where no oracle)."""

import pytest

import __spark_entry__ as entry
from cellpulse.plans.queries import REGISTRY
from conftest import SF_CHECK
from oracle_compare import compare

KEYS = list(REGISTRY)


def test_every_key_has_an_oracle():
    assert set(KEYS) <= set(entry.oracle_sql()) and set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, key):
    res = compare(spark, key, SF_CHECK)
    assert res["columns_match"], res
    assert res["rows"] == res["oracle_rows"], res
    assert res["values_match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["period", "user_id", "n_vendor", "n_type", "b_vendor", "b_type"]
    assert df.count() >= 0
