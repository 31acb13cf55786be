"""Personal data: base spans as the patterns say, votes, and what the classifier adds."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellpulse.llm import label_model, pii
from llm_frames import SF_CHECK, awkward_rows, make, nothing, shipped  # noqa: F401

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text) -> list:
    """The four patterns one after another, with their checks."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p[-4_000:]) <= 255 for p in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, docs):
    got = pii.find(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = sorted(((r.doc_id, plain(r.text)) for r in rows), key=repr)
    for r, (doc_id, spans) in zip(sorted(got, key=lambda r: repr((r.doc_id, plain_of(rows, r)))), want):
        assert r.doc_id == doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in PATTERNS)
        every = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(every) and len(every) == len(spans) + r.n_added
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
        assert order == sorted(order)


def plain_of(rows, r):
    same = [plain(x.text) for x in rows if x.doc_id == r.doc_id]
    return next(s for s in same if hashlib.sha256(",".join(s).encode()).hexdigest() == r.base_sha256)


TEXTS = ["mail a.b-c@x-y.example.com, or é@b.co; a@b a@b@c.de @x.y a@.com", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 999.1.2.3.4",
         "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 0000000000000", "+1 (068) 555-7713 +12 +1-2 +49 30 123456 +"
         "+44 20 7946 0958", "1" * 5_000 + "." + "2" * 5_000 + ".3.4", "a" * 50_000 + "@" + "b" * 50_000, "😀 +1 (068) 555-7713 😀 x@y.zz",
         "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "call 068-555-7713 now", "jane (at) mail (dot) example (dot) org", "٣٣٣ ²³"]


def test_patterns_and_awkward_rows(spark):
    check(spark, make(spark, [(500 + i, t) for i, t in enumerate(TEXTS)] + awkward_rows()))


def test_whole_table(spark):
    check(spark, spark.read.parquet(f"{SF_CHECK}/documents.parquet"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="01259.@+-() ab_%", max_size=60))
def test_base_spans_as_the_patterns(text):
    assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == plain(text)


def test_added_spans_leave_clean_texts_alone(spark):
    clean = [(i, f"In chapter {i} of version 2.{i} there were {i * 37} pages, see section 1.2.3 and table {i}.") for i in range(50)]
    found = [(100 + i, f"my card {4000000000000000 + i * 7919} please") for i in range(50)]
    got = {r.doc_id: r.n_added + r.n_card for r in pii.find(make(spark, clean + found)).collect()}
    assert all(got[i] == 0 for i, _ in clean)
    assert sum(got[i] > 0 for i, _ in found) > 40


def test_empty_table(spark, nothing):
    assert pii.find(nothing).collect() == []


def test_label_model_finds_who_is_reliable():
    import random
    rng, votes = random.Random(8), {}
    truth = []
    for _ in range(4_000):
        t = rng.random() < 0.4
        row = tuple(-1 if rng.random() < 0.2 else int(t if rng.random() < a else not t) for a in (0.95, 0.85, 0.7, 0.55))
        votes[row] = votes.get(row, 0) + 1
        truth.append((row, t))
    model = label_model.fit(list(votes), list(votes.values()))
    assert [pytest.approx(a, abs=0.05) for a in (0.95, 0.85, 0.7, 0.55)] == list(model.accuracies())
    assert model.prior == pytest.approx(0.4, abs=0.04)
    import numpy as np
    right = np.mean([(p >= 0.5) == t for p, (_, t) in zip(model.posterior(np.array([r for r, _ in truth])), truth)])
    assert right > 0.9
    assert len(label_model.fit([], []).posterior(np.empty((0, 0), np.int64))) == 0


def plain_candidates(text, base):
    """Every found span against every taken one."""
    taken, out = [(a, b) for _, a, b in base], []
    found = [(2, *m.span()) for m in pii._CARD.finditer(text) if 12 < m.end() - m.start() < 40 and 13 <= len(pii._digits(m.group())) <= 19]
    found += [(3, *m.span()) for m in pii._BARE_PHONE.finditer(text) if 7 <= len(pii._digits(m.group())) <= 12]
    found += [(0, *m.span()) for m in pii._SPELLED.finditer(text)]
    for kind, a, b in found:
        if all(b <= x or a >= y for x, y in taken):
            out.append((kind, a, b))
            taken.append((a, b))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "068-555-7713", "+1 068 555 7713", "a (at) b (dot) c", "a@b.c", "1.2.3.4",
                                 " ", ",", "-", "4000 0000 0000 0001", "x" * 70]), max_size=25))
def test_candidates_and_neighbours_as_compared_one_by_one(parts):
    text = "".join(parts)
    base = pii.base_spans(text)
    every = base + pii.candidates(text, base)
    assert every == base + plain_candidates(text, base)
    for s in every:
        near = any(o != s and min(abs(o[1] - s[2]), abs(s[1] - o[2])) <= pii.CONTEXT for o in every)
        assert pii.Spans(every).near(s[1], s[2]) == near


def test_text_of_50_000_numbers():
    import time
    text = "".join(f"call 068-555-{i:04d} or +1 068 555 {i:04d}, " for i in range(10_000)) * 5
    start = time.process_time()
    base = pii.base_spans(text)
    every = base + pii.candidates(text, base)
    others = pii.Spans(every)
    assert len(base) == 50_000 and len(every) == 100_000
    assert all(pii.votes(text, s, others)[4] == 1 for s in every[::7])
    assert time.process_time() - start < 30


def test_spelled_addresses_of_any_length():
    long = "j" * 200 + " (at) " + "m" * 90 + " (dot) a (dot) b (dot) c (dot) d (dot) e (dot) org"
    assert pii.candidates(f"write {long}, please", []) == [(0, 6, 6 + len(long))]
    assert pii.candidates("jane (at) example.com. Then more", []) == [(0, 0, 21)]
    assert pii.candidates("a." * 100_000 + " (at)", []) == []
