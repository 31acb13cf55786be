"""A hot key holding a third of all rows: results must stay exact.

The events of sf0.01 are rewritten so that every third event belongs to
user 0. Spark results are compared with a brute-force pandas computation of
the same rules on the same rows.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellpulse.constants import PROFILE_COLUMNS
from cellpulse.operators import change, profile
from cellpulse.plans import fixtures
from conftest import SF_CHECK


@pytest.fixture(scope="module")
def hot_events(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint"))
                         .otherwise(F.col("user_id")))


@pytest.fixture(scope="module")
def hot_pdf(hot_events):
    pdf = hot_events.select("event_id", "ts", "user_id", "event_type", "value").toPandas()
    pdf["period"] = np.floor((pd.to_datetime(pdf["ts"]).dt.day - 1) * 12 / 30).astype(int) + 1
    return pdf


def test_hot_key_really_is_hot(hot_pdf):
    assert (hot_pdf["user_id"] == 0).mean() > 0.33


def brute_snapshot(pdf):
    last = pdf.sort_values("event_id").groupby(["user_id", "period"]).tail(1)
    i, voice = last["event_id"], np.floor(last["value"]).astype(int)
    band = lambda k, w: (k * w).astype(str) + "-" + (k * w + w - 1).astype(str)
    return pd.DataFrame({
        "period": last["period"], "user_id": last["user_id"], "net": np.where(i % 2 == 0, "2G", "3G"),
        "gender": np.array(["F", "M", "U"])[i % 3], "age": band(last["user_id"] % 9, 10), "arpu": band(voice // 50 % 8, 50),
        "vendor": last["event_type"], "dtype": "M" + (voice // 100).astype(str),
        "bytes": band(i % 12, 500), "voice": voice, "sms": (i % 100).astype(int)})


def as_set(df):
    return {tuple(r) for r in df.itertuples(index=False)}


def test_snapshot_under_skew(hot_events, hot_pdf):
    got = fixtures.device_snapshot(hot_events).toPandas()
    want = brute_snapshot(hot_pdf)[got.columns]
    assert as_set(got) == as_set(want)


def test_changes_and_labels_under_skew(hot_events, hot_pdf):
    snap = fixtures.device_snapshot(hot_events)
    targets = snap.where("period = 12").select("user_id")
    sw = change.changed_between_periods(snap, targets).toPandas()
    lab = change.label_previous_period(snap, targets, change.changed_between_periods(snap, targets))

    s = brute_snapshot(hot_pdf).set_index(["user_id", "period"])
    tg = sorted(s.xs(12, level="period").index)
    want_sw = set()
    for u in tg:
        for p in range(2, 13):
            if p == 9 or (u, p) not in s.index or (u, p - 1) not in s.index:
                continue
            n, b = s.loc[(u, p)], s.loc[(u, p - 1)]
            if n["vendor"] != b["vendor"] and n["dtype"] != b["dtype"]:
                want_sw.add((p, u, n["vendor"], n["dtype"], b["vendor"], b["dtype"]))
    assert as_set(sw) == want_sw

    lab_pd = lab.toPandas()
    periods = sorted(set(s.index.get_level_values("period")) - {1, 9})
    assert len(lab_pd) == len(tg) * len(periods)
    hot = lab_pd[lab_pd.user_id == 0].sort_values("period")
    changed = {p for (p, u, *_rest) in want_sw if u == 0}
    assert list(hot.label) == [1 if p in changed else 0 for p in hot.period]


def test_profile_sums_under_skew(hot_events, hot_pdf):
    got = profile.sum_by_key(fixtures.usage_rows(hot_events), "user_id", PROFILE_COLUMNS).toPandas()
    pdf = hot_pdf.copy()
    band = pd.to_datetime(pdf["ts"]).dt.hour // 6
    types = fixtures.EVENT_TYPES
    for i, c in enumerate(PROFILE_COLUMNS):
        hit = (pdf["event_type"] == types[i // 4]) & (band == i % 4)
        pdf[c] = np.where(hit, np.floor(pdf["value"]), 0.0)
    want = pdf.groupby("user_id")[PROFILE_COLUMNS].sum().reset_index()
    merged = got.merge(want, on="user_id", suffixes=("", "_w"))
    assert len(merged) == len(got) == len(want)
    for c in PROFILE_COLUMNS:
        assert np.allclose(merged[c], merged[c + "_w"], rtol=0, atol=1e-9)


def test_hourly_points_under_skew(hot_events, hot_pdf):
    from cellpulse.plans.spatial import KEYS
    from cellpulse.operators.spatial import unpivot_hours
    got = unpivot_hours(fixtures.wide_locations(hot_events), KEYS).toPandas()
    pdf = hot_pdf.copy()
    ts = pd.to_datetime(pdf["ts"])
    pdf["dt"], pdf["hr"] = ts.dt.date, ts.dt.hour
    top = pdf.groupby(["user_id", "dt", "hr"])["event_id"].max().reset_index()
    top["x"] = 121.4 + (top["event_id"] % 170) / 1000.0
    top["y"] = 31.17 + (top["event_id"] % 131) / 1000.0
    want = {(r.user_id, r.dt, r.hr, r.x, r.y) for r in top.itertuples()}
    assert {(r.user_id, r.dt, r.hr, r.x, r.y) for r in got.itertuples()} == want
    assert (got["user_id"] == 0).sum() == len(top[top["user_id"] == 0])
