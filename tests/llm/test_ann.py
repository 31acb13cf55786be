"""Nearest neighbours: recall against brute force, ties, copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpulse.llm import ann
from llm_frames import SF_CHECK, shipped  # noqa: F401

SCHEMA = "vec_id bigint, embedding array<float>, g int, ids string, q string, second string, rank int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=20):
    """Largest inner products in double precision, ties to the smaller id; rows that repeat count once."""
    seen, kept = set(), []
    for i, v in rows:
        ok = i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok and (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            kept.append((i, np.array(v, np.float32).astype(float)))
    x, ids = np.array([v for _, v in kept]), np.array([i for i, _ in kept])
    out = {}
    for i, v in kept:
        if i % 20 == 0:
            score = ann.dot(x, v)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def run(frame, **settings):
    out = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, **settings).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, name):
    table = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want, got = plain(rows), run(table)
    assert set(want) == set(got)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in list(want)[:20]:
        scores = dict(want[q])
        assert all(s == scores[i] for i, s in got[q] if i in scores)


def test_recall_beyond_the_least_number_of_points(spark):
    """More vectors than every query probes anyway."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.6 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(6_000)]
    want, got = plain(rows), run(make(spark, rows), min_points=300, probes=60)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_copies_ties_lengths_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(0, 300, 3)]
    rows += [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 10])).astype(np.float32).tolist()) for i in range(1, 120, 3)]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [1.0] * 7 + [None]), (480, [float("nan")] + [1.0] * 7),
             (500, [float("inf")] + [1.0] * 7), (None, hot), (2, hot), (2, hot), (20, hot)]
    assert run(make(spark, rows)) == plain(rows)
    assert run(make(spark, rows), block=10) == plain(rows)


def test_few_and_none(spark):
    assert run(make(spark, [])) == {}
    assert run(make(spark, [(20, [1.0, 2.0])])) == {}
    assert run(make(spark, [(20, [1.0, 2.0]), (3, [2.0, 0.0])])) == {20: [(3, 2.0)]}
    assert run(make(spark, [(1, [1.0, 2.0]), (3, [2.0, 0.0])])) == {}


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 40))
    h = ann.CrossPolytope(40, 0.0)
    unit = h.unit(x, True)
    assert np.allclose((h.turned(unit, 0, 1) ** 2).sum(axis=1), 1)
    assert h.axes == 64 and ann.CrossPolytope(64, 2.0).axes == 128
    assert np.allclose(ann.hadamard(np.eye(8)) @ ann.hadamard(np.eye(8)), np.eye(8))
    longer = ann.CrossPolytope(40, 20.0)
    assert np.allclose((longer.unit(x, False) ** 2).sum(axis=1), 1)


def plain_by_length(rows):
    out = {}
    for n in {len(v) for _, v in rows}:
        out.update(plain([(i, v) for i, v in rows if len(v) == n]))
    return out


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2 if i % 5 == 0 else 3 + i % 2).astype(np.float32).tolist()) for i in range(1, 200)]
    assert run(make(spark, rows)) == {q: found for q, found in plain_by_length(rows).items() if found}


def test_one_id_with_several_vectors(spark):
    """Candidates of their own, whatever their scores, and no places lost to a query's own vectors."""
    rows = [(7, [0.9, 0.1]), (7, [0.2, 0.5]), (8, [0.0, 1.0]), (8, [0.0, 2.0]), (20, [1.0, 0.0])]
    got = run(make(spark, rows))[20]
    assert [(i, round(s, 6)) for i, s in got] == [(7, 0.9), (7, 0.2), (8, 0.0), (8, 0.0)]
    rng = np.random.default_rng(7)
    rows = [(40, rng.normal(size=4).astype(np.float32).tolist()) for _ in range(30)]
    rows += [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 30) if i % 20]
    found = ann.search(make(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert len(found) == 30 * 20 and all(r.vec_id != 40 for r in found)


def test_768_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=768).astype(np.float32).tolist()) for i in range(1, 401)]
    want, got = plain(rows), run(make(spark, rows))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("least,points", [(1, 0), (10, 5), (30, 400), (300, 2_000), (5, 10 ** 9)])
def test_probes_are_the_likeliest_buckets(least, points):
    rng = np.random.default_rng(9)
    hashing = ann.CrossPolytope(12, 0.0, tables=2)
    signed = 2 * hashing.axes
    held = rng.integers(0, 4, size=(2, signed * signed))
    keys = np.flatnonzero(held.ravel())
    counts = ann.Counts(keys, held.ravel()[keys], signed)
    unit = hashing.unit(rng.normal(size=(1, 12)), query=True)[0]
    for table in range(2):
        a, b = (np.stack([-y, y], axis=1).ravel() for y in (hashing.turned(unit[None], table, h)[0] for h in (0, 1)))
        order = np.argsort(-(a[:, None] + b[None, :]).ravel(), kind="stable")
        order = order[:max(least, int(np.searchsorted(np.cumsum(held[table][order]), points)) + 1)]
        want = [int(o) for o in order if held[table][o]]
        assert hashing.probes(unit, table, counts, least, points).tolist() == want
