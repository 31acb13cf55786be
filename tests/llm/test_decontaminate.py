"""Decontamination: tiling against a plain version, seeds lose no pair, awkward rows."""

import random
import re

import numpy as np
import pytest

from cellpulse.llm import decontaminate as dc
from llm_frames import SF_CHECK, awkward, awkward_rows, make, nothing, prose, shipped  # noqa: F401


def words(text):
    return re.findall(r"\S+", re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "")).translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_tiles(doc, item, least):
    """Greedy string tiling by definition: the longest unmarked common run, first in doc, then in item."""
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not (a[p + n] or b[q + n]):
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        if best[2] < max(1, least):
            return out
        p, q, n = best
        a[p:p + n], b[q:q + n] = [True] * n, [True] * n
        out.append(best)


def plain(docs, items, least=5, coverage=0.8):
    out = []
    for d, text in docs:
        doc = words(text)
        for i, item in items:
            item = words(item)
            tiled = sum(n for *_, n in plain_tiles(doc, item, min(least, len(item)))) if item else 0
            if item and tiled >= coverage * len(item):
                out.append((d, i, tiled, len(item)))
    return sorted(out, key=repr)


def run(spark, docs, items, **settings):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, doc_id string, tiled int")
    return sorted(((r.doc_id, r.item_id, r.tiled, r.item_tokens) for r in
                   dc.matches(make(spark, docs), frame, **settings).collect()), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_tiles_as_defined(seed):
    rng = random.Random(seed)
    doc, item = ([rng.randrange(4) for _ in range(rng.randint(0, 40))] for _ in range(2))
    least = rng.randint(1, 5)
    got = dc.tiles(np.array(doc, np.int64), np.array(item, np.int64), least)
    want = plain_tiles(doc, item, min(least, len(item))) if item else []
    assert got == want


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today."), (2, None), (3, " .,! "),
         (4, "two words"), (5, "One sentence comes first here. Another sentence follows it there. A third one ends the whole.")]


def test_reordered_partial_and_awkward(spark):
    docs = [(1, "x y " + ITEMS[0][1].upper() + " z"), (2, "A third one ends the whole, and: another sentence follows it "
            "there; one sentence comes first here"), (3, "the quick brown fox jumps"), (4, "Two  words!"), (5, "two, one words"),
            *awkward_rows()[:10], (None, ITEMS[0][1])]
    small = [(i, t) for i, t in docs if len(t or "") < 5_000]
    got = run(spark, small, ITEMS)
    assert got == plain(small, ITEMS)
    assert {(d, i) for d, i, *_ in got} >= {(1, 1), (2, 5), (4, 4), (None, 1)}


def test_sizes_of_bitmap_chunks_and_hot_seeds_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 12)) for i in range(20)]
    docs = [(i, prose(rng, 20) + " " + (items[i % 20][1] if i % 2 else "")) for i in range(30)]
    docs += [(100 + i, f"{prose(rng, 5)} {items[3][1]} {items[4][1]} {items[5][1]}") for i in range(10)]
    whole = run(spark, docs, items)
    assert len(whole) >= 45 and whole == plain(docs, items)
    for name, value in (("MOST_BITS", 1 << 15), ("SEED_BITS", 1), ("HOT", 2), ("CHUNK_BYTES", 1)):
        monkeypatch.setattr(dc, name, value)
    assert run(spark, docs, items) == whole
    clean = dc.keep_clean(make(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {d for d, *_ in whole}


def test_a_seed_of_all_items_and_documents(spark):
    """A common passage makes no pair by itself; an item that is little else is found all the same."""
    rng = random.Random(9)
    common = "all rights are reserved by the owner of this page"
    items = [(i, f"{prose(rng, 30)} i{i} {common}") for i in range(15)] + [(50, common), (51, f"{common} here"), (52, f"{common} {common}")]
    docs = [(i, f"{prose(rng, 15)} d{i} {common} e{i} {prose(rng, 15)}") for i in range(40)]
    docs += [(60 + i, f"{common} {items[i][1]}") for i in range(15)] + [(90, f"{common} x {common}")]
    got = run(spark, docs, items)
    assert got == plain(docs, items)
    assert {(60 + i, i) for i in range(15)} <= {(d, i) for d, i, *_ in got}
    pairs = dc._pairs(dc._texts(make(spark, docs), "text"), dc._texts(spark.createDataFrame(items, "item_id bigint, text string"), "text"),
                      dc.SEED, dc.COVERAGE)
    long = {r.item for r in dc._texts(spark.createDataFrame(items[:15], "item_id bigint, text string"), "text")
            .selectExpr("key as item").collect()}
    # The passage alone would make 15 x 56 pairs with the long items.
    assert 15 <= pairs.where(pairs["item"].isin([bytes(k) for k in long])).count() < 30


@pytest.mark.parametrize("coverage", [0.3, 0.8, 1.0])
def test_random_rows_against_plain(spark, coverage):
    rng = random.Random(int(coverage * 10))
    def text(n):
        return " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    items = [(i, text(rng.randint(0, 25))) for i in range(25)]
    assert run(spark, docs, items, coverage=coverage) == plain(docs, items, coverage=coverage)


def test_whole_table_has_every_planted_passage(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    bench = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")
    items = [(r.item_id, " ".join(words(r.text))) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if f" {t} " in f" {' '.join(words(r.text))} "}
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs, bench).collect()}
    assert got >= want and len(want) > 10
    assert len(got - want) <= 2


def test_empty_tables(spark, nothing, awkward):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert dc.matches(nothing, some).collect() == []
    assert dc.matches(awkward, none).collect() == []
    assert dc.keep_clean(awkward, none).count() == awkward.count()


@pytest.mark.parametrize("seed", range(30))
def test_tiles_when_all_hashes_are_equal(seed, monkeypatch):
    """Equal hashes are told apart by the tokens."""
    monkeypatch.setattr(dc, "_hashes", lambda ids, size: np.zeros(max(0, len(ids) - size + 1), np.uint64))
    test_tiles_as_defined(seed)


@pytest.mark.parametrize("doc,item", [([1] * 60, [1] * 17), ([1, 2] * 25, [2, 1] * 9), ([1] * 30 + [2] + [1] * 30, [1] * 9 + [2] + [1] * 9),
                                      ([1, 1, 2] * 15, [1, 2, 1] * 8), ([3] + [1] * 20, [1] * 25)])
def test_tiles_of_repeats(doc, item):
    for least in (1, 3, 5):
        assert dc.tiles(np.array(doc), np.array(item), least) == plain_tiles(doc, item, min(least, len(item)))


def test_long_repeated_texts_take_seconds(spark):
    same, period = np.ones(100_000, np.int64), np.tile(np.array([1, 2, 3]), 30_000)
    assert dc.tiles(same, np.ones(2_000, np.int64), 5) == [(0, 0, 2_000)]
    assert sum(n for *_, n in dc.tiles(period, np.tile(np.array([3, 1, 2]), 700), 5)) == 2_100
    docs = [(1, "a " * 100_000), (2, "a b c d e " * 20_000), (3, "a b c d e f")]
    items = [(1, "a " * 2_000), (2, "e a b c d " * 400), (3, "a b c d e f g h i j")]
    assert run(spark, docs, items) == [(1, 1, 2_000, 2_000), (2, 2, 2_000, 2_000)]


def test_too_few_shared_tokens_need_no_tiling():
    rng = random.Random(12)
    for _ in range(200):
        doc, item = (np.array([rng.randrange(3) for _ in range(rng.randint(1, 40))], np.int64) for _ in range(2))
        whole = dc.tiles(doc, item, 4)
        least = 0.8 * len(item)
        tiled = sum(n for *_, n in whole)
        got = dc.tiles(doc, item, 4, least)
        assert got == whole or (got == [] and tiled < least)
