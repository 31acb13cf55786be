"""Quality classifier: weak labellers, EM over their votes, a hashed linear scorer.

Two questions are asked of each text, *good prose?* and *free of abuse?*, each
with its own overlapping heuristic labellers. Spark counts the vote patterns
of all documents, EM (``label_model``) estimates the labellers' accuracies
from the counts, and the posterior labels of a bounded sample train one
hashed linear scorer per question. The scorers judge all documents; a
document is kept if both say yes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cellpulse.llm import label_model
from cellpulse.llm.common import lists, text_bytes, written

#: Documents that train the scorers, at most (half of them from either side, smallest hash first).
TRAINING_DOCS = 12_000
#: Slots of the hashed features.
SIZE = 1 << 16
#: Bytes of a word's start that make its feature: inflected forms share it.
START = 4
#: Words whose slot a Python worker remembers.
WORD_MEMORY = 200_000

#: Common words of the four languages, and English words of abuse: fixed lists.
ENGLISH = frozenset(w.encode() for w in (
    "the of and to in a is that for it as was with be by on not he his this are or from at which an").split())
COMMON = ENGLISH | frozenset(w.encode() for w in (
    "der die das und ist von mit den zu auf für nicht ein eine im dem des sich als auch "
    "le la les de des et un une est en que qui dans pour par sur pas du au avec "
    "el los las y que por con una su para es al lo como se del no más").split())
INSULTS = frozenset(w.encode() for w in "idiot moron clown loser scum trash jerk".split())
ABUSE = frozenset(w.encode() for w in "stupid pathetic disgusting worthless filthy".split())
_EDGE = b".,;:!?\"'()[]{}%*&#$|"
_SYMBOLS = b"#$%&*|<>{}[]\\^~_=@+"
_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
_CLASS[list(_SYMBOLS)] = 3
_CLASS[list(b"!?")] = 4
_CLASS[128:] = 5

#: Words of a block whose variety is taken, so that a text's length does not lower it.
BLOCK = 500

QUALITY = ("case", "symbols", "exclaiming", "repetition", "variety", "separators", "common words", "annotator")
TOXICITY = ("insults", "abuse", "density", "annotator")


def statistics(raw: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares that the labellers and the scorer read; all 0 for a text without words."""
    n = len(words)
    if not n:
        return {k: 0.0 for k in ("n", "upper", "symbol", "mark", "repeat", "variety", "block", "again", "common", "english", "bar", "insult", "abuse")}
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    low = raw.lower().split()
    bare = [w.strip(_EDGE) for w in low]
    blocks = [words[i:i + BLOCK] for i in range(0, n, BLOCK)]
    return {
        "n": n,
        "upper": classes[1] / max(1, classes[1] + classes[2]),
        "symbol": classes[3] / n,
        "mark": classes[4] / n,
        "repeat": sum(map(eq, words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "block": sum(len(set(b)) for b in blocks) / n,
        "again": 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / (n - 4) if n > 4 else 0.0,
        "common": sum(map(COMMON.__contains__, low)) / n,
        "english": sum(map(ENGLISH.__contains__, low)) / n,
        "bar": words.count(b"|") / n,
        "insult": sum(map(INSULTS.__contains__, bare)),
        "abuse": sum(map(ABUSE.__contains__, bare)),
    }


def quality_votes(s: dict[str, float]) -> tuple[int, ...]:
    """0 bad, 1 good, -1 abstain. Each kind of junk has a detector that else abstains.

    Texts without words get abstentions only. Low variety is that of blocks
    of ``BLOCK`` words, or half of the five-word sequences occurring again,
    whatever the length of the text.
    """
    if not s["n"]:
        return (-1,) * (len(QUALITY) - 1)
    many = s["n"] >= 30
    common = 1 if s["common"] >= 0.12 else 0 if s["common"] < 0.05 and many else -1
    return (
        0 if s["upper"] >= 0.3 and many else -1,
        0 if s["symbol"] >= 0.15 else -1,
        0 if s["mark"] >= 0.1 else -1,
        0 if s["repeat"] >= 0.1 and many else -1,
        0 if many and (s["block"] < 0.2 or s["again"] >= 0.5) else 1 if s["variety"] > 0.5 else -1,
        0 if s["bar"] >= 0.05 else -1,
        common,
    )


def toxicity_votes(s: dict[str, float]) -> tuple[int, ...]:
    """0 abusive, 1 clean. The lists are English: on other texts without a hit they abstain."""
    hits = s["insult"] + s["abuse"]
    clean = 1 if s["english"] >= 0.12 else -1
    return (
        0 if s["insult"] else clean,
        0 if s["abuse"] else clean,
        0 if hits > 0.01 * s["n"] else clean if not hits else -1,
    )


class _Slots(dict):
    """Slot of the start of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        slot = self[word] = zlib.crc32(word) % SIZE
        return slot


_SLOTS = _Slots()
_STEPS = (0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 1, 2)


def features(s: dict[str, float], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): banded statistics with value 1, words by their share of the text."""
    names = [f"{k}={sum(v > x for x in _STEPS)}" for k, v in s.items() if k != "n"]
    names.append(f"n={min(20, int(np.log2(s['n'] + 1)))}")
    bands = np.array([zlib.crc32(b"\0" + n.encode()) % SIZE for n in names])
    if not words:
        return bands, np.ones(len(bands))
    starts = [w.strip(_EDGE)[:START] for w in words]
    counts = np.bincount(np.fromiter(map(_SLOTS.__getitem__, starts), np.int64, len(words)), minlength=SIZE)
    used = np.flatnonzero(counts)
    return np.concatenate([bands, used]), np.concatenate([np.ones(len(bands)), np.sqrt(counts[used] / len(words))])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality, toxicity = [], []
        for raw in text_bytes(batch.column(2)):
            s = statistics(raw, raw.split())
            quality.append(quality_votes(s))
            toxicity.append(toxicity_votes(s))
        votes = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(quality, votes), pa.array(toxicity, votes)],
            ["doc_id", "h", "quality", "toxicity"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_text_features(raw) for raw in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
             pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["h", "slots", "shares"])


def _text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return features(statistics(raw, raw.split()), raw.lower().split())


class Classifier:
    """Fitted label models and scorers; ``score`` gives (quality, cleanness) of one text."""

    def __init__(self, models: dict[str, label_model.LabelModel], weights: dict[str, np.ndarray]):
        self.models, self.weights = models, weights

    def score(self, raw: bytes) -> tuple[float, float]:
        if not raw.split():
            return 0.0, 1.0
        slots, values = _text_features(raw)
        z = [float((w[slots] * values).sum() + w[-1]) for w in (self.weights["quality"], self.weights["toxicity"])]
        return tuple(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in z)


def _labelled(voted: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Votes with those of the annotators, who vote where they have judged a document."""
    none = F.lit(-1)
    if labels is None:
        quality, clean = none, none
    else:
        judged = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                  .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")))
        voted = voted.join(judged, "doc_id", "left")
        quality = F.when(F.col("q") > 0, 1).when(F.col("q") == 0, 0).otherwise(none)
        clean = F.when(F.col("t") > 0, 0).when(F.col("t") == 0, 1).otherwise(none)
    return voted.select("h", F.concat("quality", F.array(quality)).alias("quality"),
                        F.concat("toxicity", F.array(clean)).alias("toxicity"))


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        training_docs: int = TRAINING_DOCS) -> Classifier:
    """Vote patterns of all documents, EM, and scorers from a bounded sample.

    ``labels`` (doc_id, quality, toxic; may be absent or empty) is one more
    labeller. The sample takes up to a quarter of its size from either
    posterior class of each question, distinct texts with the smallest hash
    first, so it is the same however the rows are partitioned.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    voted = rows.mapInArrow(_votes, "doc_id bigint, h bigint, quality array<int>, toxicity array<int>")
    voted = written(_labelled(voted, labels), "votes")
    models: dict[str, label_model.LabelModel] = {}
    picked: list[Row] = []
    for question in ("quality", "toxicity"):
        # At most 3 ** labellers rows.
        patterns = voted.groupBy(question).count().orderBy(question).collect()
        models[question] = model = label_model.fit(
            [tuple(r[question]) for r in patterns], [r["count"] for r in patterns], silent=question == "toxicity")
        good = [list(r[question]) for r in patterns
                if model.posterior(np.array([r[question]]))[0] >= 0.5 and any(v >= 0 for v in r[question])]
        bad = [list(r[question]) for r in patterns
               if model.posterior(np.array([r[question]]))[0] < 0.5 and any(v >= 0 for v in r[question])]
        for side in (good, bad):
            if side:
                wanted = F.col(question).isin([F.array(*[F.lit(v) for v in p]) for p in side])
                # Copies of a text differ at most in the annotator's vote, the last one.
                picked += (voted.where(wanted).groupBy("h").agg(F.max("quality").alias("quality"), F.max("toxicity").alias("toxicity"))
                           .orderBy("h").limit(training_docs // 4).collect())
    chosen = {r["h"]: r for r in picked}
    weights = {}
    if chosen:
        # A literal list, so the scan filters by itself; its length is bounded by training_docs.
        sample = (rows.select("h", "text").where(F.col("h").isin(sorted(chosen))).dropDuplicates(["h"])
                  .mapInArrow(_sparse, "h bigint, slots array<int>, shares array<float>").toArrow().sort_by("h"))
        flat, offsets = lists(sample["slots"])
        shares, _ = lists(sample["shares"])
        matrix = [(flat[x:y], shares[x:y].astype(float)) for x, y in zip(offsets[:-1], offsets[1:])]
    for question in ("quality", "toxicity"):
        if chosen:
            target = models[question].posterior(np.array([chosen[h][question] for h in sample["h"].to_pylist()]))
            weights[question] = label_model.logistic(matrix, target, SIZE, rounds=300, penalty=1e-4)
        else:
            weights[question] = np.zeros(SIZE + 1)
    return Classifier(models, weights)


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             training_docs: int = TRAINING_DOCS) -> DataFrame:
    """``doc_id``, ``quality`` and ``clean`` (scores from 0 to 1) and ``keep`` of every row.

    A text without words (null, empty, blank) has quality 0 and is not kept.
    Null ids and repeated rows pass through; an empty table gives an empty
    result; other columns are ignored.
    """
    typ = dict(docs.dtypes)[id_col]
    model = fit(docs, labels, id_col, text_col, training_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(raw) for raw in text_bytes(batch.column(1))]).reshape(-1, 2)
            keep = (scores[:, 0] >= 0.5) & (scores[:, 1] >= 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores[:, 0]), pa.array(scores[:, 1]), pa.array(keep)],
                ["doc_id", "quality", "clean", "keep"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {typ}, quality double, clean double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
              training_docs: int = TRAINING_DOCS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    model = fit(docs, labels, id_col, text_col, training_docs)
    column = docs.columns.index(text_col)
    return docs.mapInArrow(_filter(model.score, column), docs.schema)


def _filter(score: Callable[[bytes], tuple[float, float]], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [min(score(raw)) >= 0.5 for raw in text_bytes(batch.column(column))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run
