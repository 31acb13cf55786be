"""Context-tree weighting: probabilities against a plain recursive version, counts, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpulse.llm import ctw
from llm_frames import SF_CHECK, awkward, awkward_rows, make, nothing, shipped  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


class PlainTree:
    """Definition: one recursive tree per node of the byte's binary tree."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for data in texts:
            for i in range(depth, len(data)):
                node = 1
                for k in range(8):
                    bit = data[i] >> (7 - k) & 1
                    for d in range(depth + 1):
                        c = self.counts.setdefault((node, bytes(data[i - d:i])), [0, 0])
                        c[bit] += 1
                    node = node * 2 + bit
        self.children, self.memo = {}, {}
        for node, context in self.counts:
            if context:
                self.children.setdefault((node, context[1:]), set()).add(context)

    @staticmethod
    def log_kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_w(self, node, context):
        key = node, context
        if key not in self.memo:
            own = self.log_kt(*self.counts[key])
            if len(context) == self.depth:
                self.memo[key] = own, None
            else:
                deeper = sum(self.log_w(node, c)[0] for c in self.children.get(key, ()))
                self.memo[key] = math.log(.5) + np.logaddexp(own, deeper), own - deeper
        return self.memo[key]

    def log10(self, data):
        total = 0.0
        for i in range(self.depth, len(data)):
            node = 1
            for k in range(8):
                bit = data[i] >> (7 - k) & 1
                p = 0.5
                for d in range(self.depth, -1, -1):
                    key = node, bytes(data[i - d:i])
                    if key in self.counts:
                        a = self.counts[key]
                        kt = (a[bit] + .5) / (sum(a) + 1)
                        if d == self.depth:
                            p = kt
                        else:
                            share = 1 / (1 + math.exp(min(700, -self.log_w(*key)[1])))
                            p = share * kt + (1 - share) * p
                    elif d < self.depth:
                        p = .5 * .5 + .5 * p  # an empty context believes itself and what is deeper alike
                total += math.log10(p)
                node = node * 2 + bit
        return total


def stream(text, depth):
    return b"\n" * depth + " ".join(words(text)).encode() + b"\n"


def is_train(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


@pytest.mark.parametrize("depth, chunk", [(2, 1 << 20), (4, 1 << 20), (4, 300), (5, 2_000)])
def test_scores_as_defined(spark, depth, chunk):
    rows = [(i, t) for i, t in awkward_rows() if len(t or "") < 1_500]
    tree = PlainTree([stream(t, depth) for i, t in rows if is_train(i)], depth)
    got = ctw.score(make(spark, rows), depth=depth, chunk_bytes=chunk).collect()
    want = sorted(((i, round(tree.log10(stream(t, depth)), 6)) for i, t in rows), key=repr)
    have = sorted(((r.doc_id, round(r.score, 6)) for r in got), key=repr)
    assert [i for i, _ in have] == [i for i, _ in want]
    for (i, a), (_, b) in zip(have, want):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-5), i
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes) for r in got)


def test_counts_and_base_scores(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    tokens = {r.doc_id: [*words(r.text), None] for r in rows}
    c = Counter(w for i, t in tokens.items() if is_train(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = ctw.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not is_train(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    bits = -sum(r.score for r in held) / math.log10(2) / sum(r.n_bytes for r in held)
    assert bits < 2.5  # a byte model without contexts needs over 4 on this text


def test_without_training_rows_each_decision_is_a_coin(spark):
    got = ctw.score(make(spark, [(1, "ab c"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [r.score for r in got] == [pytest.approx(-8 * 5 * math.log10(2)), pytest.approx(-8 * math.log10(2))]
    assert [r.n_known for r in got] == [0, 0] and got[0].train_tokens == 0


def test_long_texts_and_empty_table(spark, awkward, nothing):
    assert ctw.score(awkward).count() == awkward.count()
    assert ctw.score(nothing).collect() == []


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 17.5, 1e3, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)
