"""Substring dedup against a plain pass over all windows."""

import hashlib
import random

import numpy as np
import pytest

from cellpulse.llm import substring_dedup as sd
from llm_frames import SF_CHECK, awkward_rows, make, nothing, shipped  # noqa: F401


def plain(rows, width):
    """Documents in order; a set of the windows met so far."""
    seen, out = {}, {}
    order = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in order:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[i:i + width]), (doc_id, i)) != (doc_id, i):
                gone[i:i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.setdefault(doc_id, []).append((len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def check(spark, rows, width=20, **limits):
    got = sd.dedup(make(spark, rows), width).collect()
    assert len(got) == len(rows)
    want = plain(rows, width)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) in want[r.doc_id], r.doc_id


def unique_ids(rows):
    """Rows whose ids name one text each (ids of null aside): the order of documents is then plain."""
    first = {}
    return [(i, t) for i, t in rows if first.setdefault(i, t) == t]


@pytest.mark.parametrize("width", [1, 3, 20, 31, 60])
def test_awkward_rows(spark, width):
    check(spark, unique_ids(awkward_rows()), width)


def test_random_passages_shared_everywhere(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcdef") for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(passages))) for i in range(150)]
    check(spark, rows, 7)


def test_hot_passage_is_split_and_right(spark, monkeypatch):
    monkeypatch.setattr(sd, "PER_TASK", 20)
    rng = random.Random(6)
    hot = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"u{i} " * (i % 3) + (hot if rng.random() < 0.6 else f"t{i}") + f" e{i}") for i in range(300)]
    check(spark, rows, 20)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows, 20)
    got = sd.dedup(docs, with_text=False).collect()
    assert len(got) == len(rows)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][0][:3] for r in got)


def test_empty_table(spark, nothing):
    assert sd.dedup(nothing).collect() == []


def test_rolling_hash_and_anchor_depend_on_content_only():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([rng.integers(0, 2**63, 77, dtype=np.uint64), a])
    assert (sd.rolling(a, 20) == sd.rolling(b, 20)[77:]).all()
    direct = [int(sum(int(x) * pow(sd.BASE, j, 2**64) for j, x in enumerate(a[i:i + 20])) % 2**64) for i in range(5)]
    assert [int(x) for x in sd.rolling(a, 20)[:5]] == direct
    values = rng.integers(0, 5, 200, dtype=np.uint64)
    want = [max(j for j in range(i, i + 15) if values[j] == values[i:i + 15].min()) for i in range(186)]
    assert sd.last_smallest(values, 15).tolist() == want
