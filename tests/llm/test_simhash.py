"""SimHash: fingerprints by definition, components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from cellpulse.llm import simhash
from cellpulse.llm.components import components
from llm_frames import SF_CHECK, awkward_rows, make, nothing, shipped  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids_fps) -> list:
    """Smallest id reachable, per row, over links of at most 3 bits; quadratic."""
    fps = np.array([f for _, f in ids_fps], np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3):
            root[find(int(j))] = find(i)
    least = {}
    for i, (doc, _) in enumerate(ids_fps):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(ids_fps))]


def check(spark, rows):
    marked = [(i, fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(marked, plain_components(marked))), key=repr)
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_awkward_rows(spark):
    check(spark, awkward_rows())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 40])
def test_clusters_of_fingerprints(spark, bucket):
    """Chains and balls around a few centres, also with buckets cut into blocks."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(120):
            x = rng.choice((x, x)) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))})
            fps.add(x)
        ball = rng.getrandbits(64)
        fps |= {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(frame, bucket)).collect()}
    want = plain_components([(f, f % (1 << 64)) for f in signed])
    classes, expected = {}, {}
    for f, w in zip(signed, want):
        classes.setdefault(found.get(f, f), set()).add(f)
        expected.setdefault(w, set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_pigeonring_keys_meet_for_every_pair_within_three_bits():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))})
        pair = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(simhash.near(*pair, start)[0] for start in range(8))
    far = np.array([0], np.uint64), np.array([15], np.uint64)
    assert not any(simhash.near(*far, start)[0] for start in range(8))


def test_keep_one_of_each_component(spark):
    rows = awkward_rows()
    docs = make(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    component = {(r.doc_id, r.h): r.component_id for r in simhash.near_duplicates(docs).collect()}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted({c for c in component.values()})


def test_empty_table(spark, nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.keep_one(nothing).collect() == []


def test_components_of_a_long_chain_and_odd_links(spark):
    n = 300
    links = [(i, i + 1) if i % 2 else (i + 1, i) for i in range(n)] + [(7, 7), (None, 3), (1000, 999), (999, 1000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1000: 999}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
