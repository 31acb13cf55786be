"""Personal data: labellers vote on candidate spans, EM weighs them, a span classifier decides.

1. One scan over the texts finds the base spans (fixed patterns and checks) and
   *candidates*: digit chains of card length that fail the checksum, phone
   forms without ``+``, and spelled-out e-mail addresses. Regex, gazetteer and context labellers vote
   on every base span and candidate.
2. Spark counts the vote patterns of all spans; EM estimates how reliable each
   labeller is (``label_model``).
3. The posterior labels of a bounded sample of spans train a logistic span
   classifier over the span's form and context, which decides on the
   candidates. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import label_model
from cellpulse.llm.common import text_bytes
from cellpulse.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Spans that train the span classifier, at most (those with the smallest hash).
TRAINING_SPANS = 20_000
#: Characters on either side that the context labeller and features read.
CONTEXT = 60
SIZE = 1 << 12

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts, so the look-behind loses none.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BARE_PHONE = re.compile(r"(?<![0-9+(.])(?:\([0-9]{2,4}\)|[0-9]{2,4}(?=[\x20.-]))(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9.])")
# The local part is a whole run, of any length: no place inside a run is tried.
_SPELLED = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]++"
                      r"(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[a-z0-9-]++)++")
#: Words that announce personal data, in the four languages of the corpus.
CUES = {
    "email": "email e-mail mail contact write courriel correo kontakt".split(),
    "ip": "ip address host server login client adresse dirección".split(),
    "card": "card visa mastercard credit debit payment account karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile fax telefon téléphone teléfono".split(),
}
#: Words that announce other numbers.
OTHER = "isbn issn version order invoice serial part item page".split()
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for place, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        total += n if place % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; each kind leftmost and non-overlapping."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        # The local part is the whole run before the sign: linear, unlike a search.
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the base patterns leave, clear of base spans and of each other."""
    # Taken stretches, apart from each other and in order.
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found = [(2, *m.span()) for m in _CARD.finditer(text)
             if 12 < m.end() - m.start() < 40 and 13 <= len(_digits(m.group())) <= 19]
    found += [(3, *m.span()) for m in _BARE_PHONE.finditer(text) if 7 <= len(_digits(m.group())) <= 12]
    if "at)" in text.lower() or "at]" in text.lower():
        found += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    out = []
    for kind, a, b in found:
        at = bisect_right(ends, a)  # the first stretch that ends after the span starts
        if at == len(starts) or starts[at] >= b:
            out.append((kind, a, b))
            starts.insert(at, a)
            ends.insert(at, b)
    return out


#: What the labellers read: fixed lists.
_TLDS = set("com org net edu gov info io de fr es uk eu".split())
LABELLERS = ("form", "check", "gazetteer", "context", "neighbours")


class Spans:
    """Places of a text's spans, in order, to ask what is near one of them."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = sorted(a for _, a, _ in spans), sorted(b for _, _, b in spans)

    def near(self, a: int, b: int) -> bool:
        """Another span starts near the end, or ends near the start, of the span at (a, b)."""
        own = b - a <= CONTEXT  # then it counts itself
        return any(bisect_right(places, at + CONTEXT) - bisect_left(places, at - CONTEXT) > own
                   for places, at in ((self.starts, b), (self.ends, a)))


def votes(text: str, span: tuple[int, int, int], others: Spans) -> tuple[int, ...]:
    """Votes of the labellers on one span: personal (1), not (0), abstain (-1)."""
    kind, a, b = span
    got = text[a:b]
    digits = _digits(got)
    form = {0: 1 if "@" in got else -1, 1: 1,
            2: 1 if len(digits) in (15, 16) else 0,
            3: 1 if got.startswith("+") or "(" in got else -1}[kind]
    check = {0: 1 if "@" in got else -1, 1: 0 if digits.startswith("0") else 1,
             2: 1 if luhn(digits) else -1, 3: 1 if 9 <= len(digits) <= 12 else 0}[kind]
    gazetteer = -1
    if kind == 0:
        gazetteer = int(got.rpartition(".")[2].lower() in _TLDS)
    elif kind == 2:
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == 3:
        gazetteer = 1 if "555" in digits or digits.startswith("1") else -1
    around = [w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT):a])[-5:]]
    context = 1 if any(w in CUES[KINDS[kind]] for w in around) else 0 if any(w in OTHER for w in around) else -1
    # A number that stands alone between words; not glued into a longer token.
    free = (a == 0 or text[a - 1] in " \t\n\r(\"'|,:;") and (b == len(text) or not (text[b].isalnum() or text[b] in "_/=-"))
    neighbours = int(free)
    if others.near(a, b):
        neighbours = 1
    return form, check, gazetteer, context, neighbours


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % SIZE


def features(text: str, span: tuple[int, int, int], vote: tuple[int, ...]) -> list[int]:
    """Hashed binary features of a span: form, votes and the words around it."""
    kind, a, b = span
    got = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", got))))[:24]
    names = [f"kind={kind}", f"shape={kind}:{shape}", f"digits={kind}:{len(_digits(got))}"]
    names += [f"{name}={kind}:{v}" for name, v in zip(LABELLERS, vote)]
    names += [f"before={w.lower()}" for w in _WORD.findall(text[max(0, a - CONTEXT):a])[-2:]]
    return sorted({_slot(n) for n in names})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, spans = [], []
        for raw in text_bytes(batch.column(1)):
            text = raw.decode()
            own = base_spans(text) if any(c in raw for c in b"0123456789@+") else []
            more = candidates(text, own) if _has_candidate(raw) else []
            every = own + more
            others = Spans(every)
            base.append([{"kind": k, "a": a, "b": b} for k, a, b in own])
            rows = []
            for i, s in enumerate(every):
                v = votes(text, s, others)
                rows.append({"kind": s[0], "a": s[1], "b": s[2], "added": i >= len(own),
                             "votes": list(v), "features": features(text, s, v)})
            spans.append(rows)
        span = pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        full = pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("added", pa.bool_()),
                          ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(full))],
            ["doc_id", "base", "spans"])


_DIGIT = re.compile(rb"[0-9]|\(at\)|\[at\]|\(AT\)|\[AT\]")


def _has_candidate(raw: bytes) -> bool:
    return _DIGIT.search(raw) is not None


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         training_spans: int = TRAINING_SPANS) -> DataFrame:
    """Personal data of every text.

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base
    spans), ``base_sha256``, ``spans`` (base and added ones as
    ``kind:start:end``, by kind then start, in code points, end exclusive) and
    ``n_added``. One row out per row in. A null or empty text has no spans.
    Null ids and repeated rows pass through; an empty table gives an empty
    result; other columns are ignored.
    """
    typ = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialize(rows.mapInArrow(
        _scan, f"doc_id {typ}, base array<struct<kind:int,a:bigint,b:bigint>>, "
        "spans array<struct<kind:int,a:bigint,b:bigint,added:boolean,votes:array<int>,features:array<int>>>"))
    spans = scanned.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).select("s.votes", "s.features")
    # At most 3 ** labellers patterns.
    patterns = spans.groupBy("votes").count().orderBy("votes").collect()
    model = label_model.fit([tuple(r["votes"]) for r in patterns], [r["count"] for r in patterns])
    sample = (spans.select("votes", "features", F.xxhash64("votes", "features").alias("o"))
              .orderBy("o", "features").limit(training_spans).collect())
    target = model.posterior(np.array([r["votes"] for r in sample])) if sample else np.empty(0)
    weights = label_model.logistic(
        [(np.array(r["features"]), np.ones(len(r["features"]))) for r in sample], target, SIZE)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(s["kind"], s["a"], s["b"]) for s in base]
                more = [(s["kind"], s["a"], s["b"]) for s in spans
                        if s["added"] and weights[s["features"]].sum() + weights[-1] > 0]
                counts = [sum(k == kind for k, _, _ in own) for kind in range(4)]
                out.append((*counts, hashlib.sha256(_join(own).encode()).hexdigest(), _join(own + more), len(more)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return scanned.mapInArrow(decide, f"doc_id {typ}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                              "base_sha256 string, spans string, n_added bigint")
