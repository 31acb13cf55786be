"""Importance resampling: against a plain version, SQL, and a sorted list for the cutoff."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle_compare
from cellpulse.llm import resample
from llm_frames import SF_CHECK, awkward, nothing, shipped  # noqa: F401

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, percent, min_words, longest=1, buckets=resample.BUCKETS, seed="2024"):
    def features(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        words = WORD.findall(raw)
        return len(words), [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    def counts(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])

    s, t = counts(x for _, x in rows), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out, able = [], []
    for n, (key, text) in enumerate(rows):
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
                     for b in (zlib.crc32(f) % buckets for f in found))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None])
        if words >= min_words:
            able.append((-score, key is None, key or 0, n))
    for rank, (*_, n) in enumerate(sorted(able)[:len(able) * percent // 100], 1):
        out[n][4] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent,min_words,longest", [(10, 20, 1), (50, 1, 2), (100, 0, 3), (0, 20, 1)])
def test_as_the_plain_version(spark, awkward, percent, min_words, longest):
    texts = ["the word of two words", None, "", "naïve zq"]
    target = spark.createDataFrame([(t, 1) for t in texts], "text string, n int")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = rows_of(resample.resample(awkward, target, percent, min_words, longest=longest))
    assert got == plain(rows, texts, percent, min_words, longest)


def test_as_sql_over_its_table(spark):
    found = oracle_compare.compare(spark, "op11_resample", SF_CHECK)
    assert found["columns_match"] and found["values_match"] and found["rows"] == 1000


def test_empty_tables(spark, awkward, nothing):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(nothing, awkward).collect() == []
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(resample.resample(awkward, target)) == plain(rows, [], 10, 20)


def test_tied_scores_and_repeated_rows(spark):
    rows = [(7, "same text here")] * 40 + [(i, "same text here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    target = spark.createDataFrame([("text",)], "text string")
    assert rows_of(resample.resample(docs, target, 35, 1)) == plain(rows, ["text"], 35, 1)


@pytest.mark.parametrize("partitions", [1, 9])
def test_cutoff_is_the_key_of_its_rank(spark, partitions, monkeypatch):
    monkeypatch.setattr(resample, "KEYS_PER_PARTITION", 500)
    rows = [((i * 7919) % 101, i % 640) for i in range(3_000)] + [(50, 3)] * 500
    frame = spark.createDataFrame(rows, "score bigint, key bigint").repartition(partitions)
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for wanted in (1, 2, 1_200, 1_700, 3_499, 3_500):
        score, key, before, rounds = resample.cutoff(frame, wanted)
        assert (score, key) == order[wanted - 1]
        assert before == sum((-s, k) < (-score, key) for s, k in rows)
        assert rounds <= 2 + math.log(len(rows)) / math.log(4 / 3)
    with pytest.raises(ValueError):
        resample.cutoff(frame, 3_501)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=9), min_size=1, max_size=7))
def test_pivot_discards_a_quarter(parts):
    in_order = [sorted(p, key=lambda r: (-r[0], r[1])) for p in parts]
    pivot = resample.weighted_median([(len(p), *p[(len(p) - 1) // 2]) for p in in_order])
    keys = [(-s, k) for p in parts for s, k in p]
    at = (-pivot[0], pivot[1])
    assert 4 * sum(k <= at for k in keys) >= len(keys)
    assert 4 * sum(k >= at for k in keys) >= len(keys)
