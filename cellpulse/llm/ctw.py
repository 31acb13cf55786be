"""Language-model scoring by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, joined by one space, and one end byte.
Each byte is eight binary decisions, and each decision (a node of the byte's
binary tree) has a context tree of its own over the last ``DEPTH`` bytes. In
every context of every depth a Krichevsky-Trofimov estimator counts zeros and
ones of the training texts; weighting mixes all depths: a context believes
its own estimator as far as it explains the training data better than its
deeper contexts together do. The score is the log10 probability of all bytes.

How it runs. A window of ``DEPTH + 1`` bytes fixes a byte's probability, so
everything works on distinct windows:

1. One scan cuts the documents into *chunks* of bounded size and writes, per
   chunk, the packed texts, its distinct windows and its distinct words, each
   with their counts in training documents.
2. Windows and words are summed over all chunks by shuffles that carry one
   row per chunk and distinct value, not per occurrence.
3. The context trees are computed per last two context bytes, from the
   deepest level up; the two shallowest levels (at most 255 nodes in each of
   256 + 1 contexts) are finished from sums on the driver.
4. Each chunk gets back the probabilities of its windows and the counts of
   its words, and scores its documents.

No model is ever held whole in one place; all shuffles grow in proportion to
the text.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import lists, text_bytes, written

DEPTH = 4
#: Text bytes of one chunk, and of one vectorised step.
CHUNK_BYTES = 32 << 20
STEP_BYTES = 3 << 20
#: Windows of one step of the tree computation.
TREE_WINDOWS = 150_000
END = b"\n"
LOG10 = np.log(10.0)


def normal(raw: bytes) -> bytes:
    """The bytes that are scored, without the end: bytes.lower/split know just A-Z and ASCII spaces."""
    return b" ".join(raw.lower().split())


def windows(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(windows, windows per text): one window per byte, the end included.

    A window is ``depth`` context bytes, oldest first, then the byte. The
    context before a text is end bytes.
    """
    pad = END * depth
    data = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    out = np.zeros(max(0, len(data) - depth), np.uint64)
    for j in range(depth + 1):
        out = (out << np.uint64(8)) | data[j:j + len(out)]
    inside = np.ones(len(data), bool)
    ends = np.cumsum(sizes + depth)
    for j in range(depth):  # the last ``depth`` starts of a text reach into the next one
        inside[ends - 1 - j] = False
    return out[inside[:len(out)]], sizes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series at x + 7."""
    y = x + 7
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680 - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any order of the counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def own_weight(log_own: np.ndarray, log_deeper: np.ndarray) -> np.ndarray:
    """Share of a context's own estimator in its mixture, after the training data."""
    return 1 / (1 + np.exp(np.clip(log_deeper - log_own, -700, 700)))


def _sum_by(keys: np.ndarray, *values: np.ndarray):
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, inverse, [np.bincount(inverse, weights=v, minlength=len(unique)) for v in values]


def subtree(window: np.ndarray, count: np.ndarray, depth: int = DEPTH, top: int = 2):
    """Trees from ``depth`` up to contexts of ``top`` bytes, for windows that hold those contexts whole.

    Returns the probabilities of each window's eight decisions mixed down to
    level ``top`` (rows of 8), and of the level-``top`` nodes: key (context and
    tree node), zeros, ones, log weighted probability.
    """
    byte = (window & np.uint64(255)).astype(np.int64)
    context = window >> np.uint64(8)
    bit_no = np.arange(8)
    bits = (byte[:, None] >> (7 - bit_no)) & 1
    nodes = (1 << bit_no) | (byte[:, None] >> (8 - bit_no))
    keys = ((context[:, None] << np.uint64(8)) | nodes.astype(np.uint64)).ravel()
    flat, n = bits.ravel(), np.repeat(count.astype(float), 8)
    unique, inverse, (zeros, ones) = _sum_by(keys, n * (flat == 0), n * (flat == 1))
    log_w = log_kt(zeros, ones)
    taken = np.where(flat == 1, ones[inverse], zeros[inverse])
    p = (taken + 0.5) / (zeros + ones + 1)[inverse]
    at = inverse
    for level in range(depth - 1, top - 1, -1):
        mask = np.uint64((1 << (8 * level + 8)) - 1)
        unique, up, (zeros, ones, deeper) = _sum_by(unique & mask, zeros, ones, log_w)
        at = up[at]
        own = log_kt(zeros, ones)
        share = own_weight(own, deeper)[at]
        taken = np.where(flat == 1, ones[at], zeros[at])
        p = share * (taken + 0.5) / (zeros + ones + 1)[at] + (1 - share) * p
        log_w = np.log(0.5) + np.logaddexp(own, deeper)
    return p.reshape(-1, 8), (unique, zeros, ones, log_w)


class Top:
    """Levels 1 and 0 of all trees, from the sums over the level-2 nodes below each level-1 node."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray):
        own = log_kt(zeros, ones)
        log_w = np.log(0.5) + np.logaddexp(own, deeper)
        self.levels = [self._table(keys, zeros, ones, own_weight(own, deeper), 1 << 16)]
        node, _, (zeros, ones, deeper) = _sum_by(keys & 255, zeros, ones, log_w)
        own = log_kt(zeros, ones)
        self.levels.append(self._table(node, zeros, ones, own_weight(own, deeper), 1 << 8))

    @staticmethod
    def _table(keys, zeros, ones, share, size):
        table = np.zeros((size, 3))
        table[:, 0], table[:, 1] = 0.5, 0.5  # never seen: one half, either way
        table[keys, 0] = share
        table[keys, 1] = (ones + 0.5) / (zeros + ones + 1)
        return table

    def log10(self, window: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each window's byte, from the level-2 mixtures of its decisions."""
        byte = (window & np.uint64(255)).astype(np.int64)
        last = ((window >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(window))
        for k in range(8):
            bit = (byte >> (7 - k)) & 1
            node = (1 << k) | (byte >> (8 - k))
            mixed = p[:, k]
            for table, key in ((self.levels[0], (last << 8) | node), (self.levels[1], node)):
                share, one = table[key, 0], table[key, 1]
                mixed = share * np.where(bit == 1, one, 1 - one) + (1 - share) * mixed
            total += np.log(mixed)
        return total / LOG10


class WindowTable:
    """Values by window: a slot table that holds most windows, and a sorted search for the rest."""

    def __init__(self, window: np.ndarray, value: np.ndarray):
        order = np.argsort(window)
        self.window, self.value = window[order], value[order]
        bits = max(8, min(22, int(len(window)).bit_length() + 3))
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.window)] = np.arange(len(window), dtype=np.int32)

    def _slot(self, window: np.ndarray) -> np.ndarray:
        return (window * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __getitem__(self, window: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(window)]
        other = np.flatnonzero(self.window[at] != window)
        at[other] = np.searchsorted(self.window, window[other])
        return self.value[at]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > STEP_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def _distinct_windows(texts: list[bytes], trains: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of all texts and their counts in the training ones."""
    found, counts = [np.empty(0, np.uint64)], [np.empty(0)]
    for train in (True, False):
        own = [t for t, flag in zip(texts, trains) if flag == train]
        for lo, hi in _pieces(own):
            unique, n = np.unique(windows(own[lo:hi], depth)[0], return_counts=True)
            found.append(unique)
            counts.append(n * float(train))
    unique, _, (n,) = _sum_by(np.concatenate(found), np.concatenate(counts))
    return unique, n.astype(np.int64)


def _chunks(depth: int, chunk_bytes: int):
    """Scan step: one row per chunk with its packed texts, windows and words."""
    def emit(ids, trains, texts):
        window, n = _distinct_windows(texts, trains, depth)
        words: Counter = Counter()
        for text, train in zip(texts, trains):
            if train:
                words.update(text.split())
        for text, train in zip(texts, trains):
            if not train:
                for w in text.split():
                    words[w] += 0
        packed = zstandard.ZstdCompressor(level=3).compress(END.join(texts))
        word = pa.binary()
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([trains], pa.list_(pa.bool_())), pa.array([packed], pa.binary()),
             pa.array([window.view(np.int64)], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
             pa.array([list(words)], pa.list_(word)), pa.array([list(words.values())], pa.list_(pa.int64()))],
            ["chunk", "ids", "trains", "packed", "windows", "window_n", "words", "word_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, trains, texts, size = [], [], [], 0
        for batch in batches:
            for i, train, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                ids.append(i)
                trains.append(train)
                texts.append(normal(raw))
                size += len(raw)
                if size >= chunk_bytes:
                    yield emit(ids, trains, texts)
                    ids, trains, texts, size = [], [], [], 0
        if ids:
            yield emit(ids, trains, texts)
    return run


def _grow_trees(depth: int):
    """Windows sorted by their last two context bytes to level-2 mixtures and nodes."""
    def compute(window, count):
        p, (keys, zeros, ones, log_w) = subtree(window, count, depth)
        m, k = len(window), len(keys)
        offsets = np.arange(0, 8 * m + 1, 8, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(window.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel())),
             pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.float64())] * 3], ["window", "p", "node", "zeros", "ones", "log_w"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.float64())), pa.array(keys.view(np.int64)),
             pa.array(zeros), pa.array(ones), pa.array(log_w)], ["window", "p", "node", "zeros", "ones", "log_w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, count = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            window = np.concatenate([window, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            count = np.concatenate([count, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(window) >= TREE_WINDOWS:  # up to the last whole group
                group = (window >> np.uint64(8)) & np.uint64(0xFFFF)
                other = np.flatnonzero(group != group[-1])
                if len(other):
                    cut = other[-1] + 1
                    yield from compute(window[:cut], count[:cut])
                    window, count = window[cut:], count[cut:]
        if len(window):
            yield from compute(window, count)
    return run


def _mix_top(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window = batch.column(0).to_numpy(zero_copy_only=False)
            p, offsets = lists(batch.column(1))
            p = p[offsets[0]:offsets[-1]].reshape(-1, 8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window), pa.array(top.log10(window.view(np.uint64), p))], ["window", "value"])
    return run


def _score(depth: int, total: int, distinct: int, ends: int):
    """Cogroup step: a chunk's texts with the values of its windows and words."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    floor = np.log10(total + distinct + 1.0)

    def run(packs: pa.Table, values: pa.Table) -> pa.Table:
        own = values.filter(pc.is_valid(values["window"]))
        logs = WindowTable(own["window"].to_numpy().view(np.uint64), own["value"].to_numpy())
        own = values.filter(pc.is_valid(values["word"]))
        # log10(count + 1): zero for a word that training has not seen, and only then.
        base = dict(zip(own["word"].to_pylist(), np.log10(own["value"].to_numpy() + 1).tolist()))
        rows = []
        for ids, trains, packed in zip(packs["ids"].to_pylist(), packs["trains"].to_pylist(), packs["packed"].to_pylist()):
            texts = zstandard.ZstdDecompressor().decompress(packed).split(END)
            for lo, hi in _pieces(texts):
                got, sizes = windows(texts[lo:hi], depth)
                scores = np.add.reduceat(logs[got], np.cumsum(sizes) - sizes)
                for i in range(lo, hi):
                    each = list(map(base.__getitem__, texts[i].split()))
                    n = len(each) + 1
                    rows.append((ids[i], not trains[i], n, len(each) - each.count(0.0) + (ends > 0), total,
                                 sum(each) + float(np.log10(ends + 1)) - n * floor,
                                 float(scores[i - lo]), int(sizes[i - lo])))
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    return run


def train_rows(id_col: str = "doc_id", parts: int = 7, held_out: int = 2) -> Column:
    """True for rows that the model learns from: crc32 of the id as text modulo ``parts`` is not ``held_out``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts != held_out


def score(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every text with a model of the rows where ``train`` is true.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and one end),
    ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score``
    (add-one unigrams, log10), ``score`` (the context-tree model, log10) and
    ``bits_per_byte``. One row out per row in. A null, empty or blank text is
    its end alone. A null ``train`` is false. Null ids and repeated rows pass
    through, each a text of its own; without training rows every decision has
    probability one half. An empty table gives an empty result. ``doc_id``
    must be integral; other columns are ignored.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6 bytes")
    train = train_rows(id_col) if train is None else train
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text_col).cast("string").alias("text"))
    chunks = written(rows.mapInArrow(
        _chunks(depth, chunk_bytes),
        "chunk binary, ids array<bigint>, trains array<boolean>, packed binary, windows array<bigint>, "
        "window_n array<bigint>, words array<binary>, word_n array<bigint>"), "lm-chunks")

    by_window = chunks.select("chunk", F.explode(F.arrays_zip("windows", "window_n")).alias("x")).select(
        "chunk", F.col("x.windows").alias("window"), F.col("x.window_n").alias("n"))
    by_word = chunks.select("chunk", F.explode(F.arrays_zip("words", "word_n")).alias("x")).select(
        "chunk", F.col("x.words").alias("word"), F.col("x.word_n").alias("n"))

    group = F.shiftrightunsigned("window", 8).bitwiseAND(F.lit(0xFFFF))
    sums = by_window.groupBy("window").agg(F.sum("n").alias("n"))
    trees = written(sums.withColumn("g", group).repartition("g").sortWithinPartitions("g", "window").select("window", "n")
                    .mapInArrow(_grow_trees(depth), "window bigint, p array<double>, node bigint, "
                                "zeros double, ones double, log_w double"), "lm-trees")
    # One row per last byte and tree node: 256 x 255 at most.
    roots = (trees.where("node is not null")
             .groupBy(F.col("node").bitwiseAND(F.lit(0xFFFF)).alias("node"))
             .agg(F.sum("zeros"), F.sum("ones"), F.sum("log_w")).orderBy("node").collect())
    top = Top(*(np.array([r[i] for r in roots], np.int64 if i == 0 else float) for i in range(4)))
    logs = trees.where("window is not null").select("window", "p").mapInArrow(_mix_top(top), "window bigint, value double")

    counts = written(by_word.groupBy("word").agg(F.sum("n").alias("value")), "lm-words")
    # Ends: one per training text.
    ends = chunks.agg(F.sum(F.size(F.filter("trains", lambda t: t)))).first()[0] or 0
    tokens, distinct = counts.where("value > 0").agg(F.coalesce(F.sum("value"), F.lit(0)), F.count("*")).first()

    no_word, no_window = F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("window")
    values = (by_window.select("chunk", "window").join(logs, "window").select("chunk", "window", no_word, "value")
              .unionByName(by_word.select("chunk", "word").join(counts, "word")
                           .select("chunk", no_window, "word", F.col("value").cast("double").alias("value"))))
    scored = (chunks.select(F.col("chunk").alias("own"), "ids", "trains", "packed").groupBy("own")
              .cogroup(values.groupBy("chunk"))
              .applyInArrow(_score(depth, int(tokens + ends), int(distinct + (ends > 0)), int(ends)),
                            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                            "base_score double, score double, n_bytes bigint"))
    return scored.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))
