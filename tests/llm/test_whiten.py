"""Whitening: eigenproblem against numpy, the operator against a plain version."""

import math

import numpy as np
import pytest

from cellpulse.llm import whiten
from llm_frames import SF_SMALL, shipped  # noqa: F401

RNG = np.random.default_rng(5)
SCHEMA = "vec_id bigint, embedding array<float>, label int, x array<int>, n string, i int"


def frame(spark, vectors, ids=None, partitions=3):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 1, [1], "n", 2)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def plain(vectors, k=4):
    """(whitened, explained, deviations, n) of vectors of one length."""
    x = np.floor(256 * np.asarray(vectors, np.float32).astype(float))
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    centred = fit - mean
    v = centred.T @ centred / n
    values, found = np.linalg.eigh(v)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    sums = [int(s) for s in fit.sum(axis=0)]
    deviations = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return (x - mean) @ found / np.sqrt(values), values / np.trace(v), deviations, n


def same_up_to_sign(got, want):
    signs = np.sign((got * want).sum(axis=0))
    return np.abs(got - want * signs).max()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 200])
def test_leading_eigenpairs(n):
    a = RNG.standard_normal((n, n))
    a = a @ a.T
    values, vectors = whiten.leading(a, 5)
    want = np.linalg.eigvalsh(a)[::-1][:5]
    assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * want[0])
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-11 * want[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 1, 1], [3, 3 * (1 - 1e-9), 3 * (1 - 2e-9), 1, 0.5, 0], [1] * 6, [0] * 6,
                                    [4, 4, 0, 0, 0, 0]])
def test_repeated_and_close_eigenvalues(values):
    q, _ = np.linalg.qr(RNG.standard_normal((6, 6)))
    for a in (q @ np.diag(values) @ q.T, np.diag(np.array(values, float))):
        a = (a + a.T) / 2
        got, vectors = whiten.leading(a, 4)
        assert np.allclose(got, sorted(values)[::-1][:4], atol=1e-12 * max(1, max(values)))
        assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-10
        assert np.abs(a @ vectors.T - vectors.T * got).max() <= 1e-10 * max(1, max(values))


def test_sturm_counts():
    d, e = RNG.standard_normal(30), RNG.standard_normal(29)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    points = np.linspace(-4, 4, 50)
    assert whiten.smaller_than(d, e * e, points).tolist() == [int((np.linalg.eigvalsh(t) < p).sum()) for p in points]


def test_awkward_rows_as_the_plain_version(spark):
    good = [RNG.normal(0, 0.2, 6) * [5, 3, 2, 1.5, 1, 1] for _ in range(150)]
    good += [good[3]] * 60 + [[-0.0, 0, 0, 0, 0, 0]]
    bad = [None, [None, 1, 1, 1, 1, 1], [float("nan"), 1, 1, 1, 1, 1], [float("inf"), 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, float("-inf")]]
    ids = list(range(len(good))) + [None] * len(bad)
    ids[5], ids[7] = None, 6  # a null id and a repeated one
    rows = whiten.whiten(frame(spark, good + bad, ids)).collect()
    white, explained, deviations, n = plain(good)
    assert len(rows) == 4 * len(good) and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1
    got = sorted((r.deviation, r.component) for r in rows)
    assert got == sorted((d, c) for d in deviations for c in range(1, 5))
    assert np.allclose(sorted({r.explained for r in rows})[::-1], explained, rtol=1e-10)
    unique = [i for i, key in enumerate(ids[:len(good)]) if key is not None and ids.count(key) == 1]
    place = {ids[i]: i for i in unique}
    table = np.zeros((len(good), 4))
    for r in rows:
        if r.vec_id in place:
            table[place[r.vec_id], r.component - 1] = r.whitened
    assert same_up_to_sign(table[unique], white[unique]) < 1e-9


def test_query_over_its_table(spark):
    import __spark_entry__ as entry
    rows = entry.queries()["op12_whitening"](spark, SF_SMALL).collect()
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    white, explained, deviations, n = plain([r.embedding for r in table])
    at = {r.vec_id: i for i, r in enumerate(table)}
    got = np.zeros_like(white)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[at[r.vec_id]] and r.n == n
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-10)
    assert same_up_to_sign(got, white) < 1e-9 and len(rows) == 4 * len(table)


def test_lengths_are_tables_of_their_own(spark):
    three = [RNG.normal(0, 1, 3) for _ in range(40)]
    five = [RNG.normal(0, 1, 5) for _ in range(30)]
    rows = whiten.whiten(frame(spark, three + five + [[], [1.0]])).collect()
    assert {(r.vec_id < 40, r.n) for r in rows} == {(True, 40), (False, 30)}
    assert len(rows) == 3 * 40 + 4 * 30


def test_tables_without_variance(spark):
    assert whiten.whiten(frame(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert whiten.whiten(frame(spark, [None])).collect() == []
    empty = whiten.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert empty.collect() == []
    flat = whiten.whiten(frame(spark, [[float(i), 0.0, 2.0 * i] for i in range(20)])).collect()
    assert {r.component for r in flat} == {1}


def test_deviations_beyond_63_bits_are_null(spark):
    rows = whiten.whiten(frame(spark, [[1e8, 0], [-1e8, 1], [0, 3e7], [5, 5]])).collect()
    assert len(rows) == 8
    x = np.floor(256 * np.array([[1e8, 0], [-1e8, 1], [0, 3e7], [5, 5]], np.float32).astype(float)).astype(object)
    want = [sum((4 * c - s) ** 2 for c, s in zip(row, x.sum(axis=0))) for row in x]
    assert {r.vec_id: r.deviation for r in rows} == {i: int(d) if d < 2 ** 63 else None for i, d in enumerate(want)}
