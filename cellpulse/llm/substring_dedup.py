"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words.

A word is removed if some window that covers it also starts earlier (smaller
document, or same document and earlier start). The windows are those of the
input, never of what is left.

How it scales. A window's *anchor* is the smallest hash of the ``GRAM``-word
sequences inside it, a function of its words alone, so equal windows have
equal anchors. About one word in eight is an anchor position. Phase 1 counts
anchors only; an anchor seen once can hold no repeated window. Phase 2 hashes
every window of the anchors that are left and sends those, together, to the
task of their anchor, which decides what repeats. Nothing is sampled: phase 1
only rules out windows that occur once. Anchors with many occurrences are
split over tasks by a salt, and the first windows of the parts are compared
in one more, small, step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellpulse.llm.common import lists, slices, text_bytes, words_of, written

GRAM = 6
#: Odd base of the polynomials modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Occurrences of one anchor that one task takes.
PER_TASK = 20_000
#: Words that one vectorised step takes.
STEP_WORDS = 500_000
NULL_ID = -(1 << 63)

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(max(n, STEP_WORDS), base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (start i at index i)."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.astype(np.uint64, copy=False) * up, dtype=np.uint64)])
    return (total[width:] - total[:-width]) * down[:n - width + 1]


def last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (the last of equals) in each run of ``width``."""
    index, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = index[:-step], index[step:]
        index = np.where(values[right] <= values[left], right, left)
        span += step
    return index


def anchor_runs(words: np.ndarray, bounds: np.ndarray, width: int):
    """(document index, first window, windows, anchor) of each run of windows with one anchor.

    ``bounds`` are the offsets of the documents in ``words``. A run never
    holds two equal windows: the later one's last smallest sequence would
    lie further right.
    """
    gram = min(GRAM, width)
    grams = rolling(words, gram)
    sizes = np.diff(bounds)
    if len(words) < width:
        return [np.empty(0, np.int64)] * 4
    where = last_smallest(grams, width - gram + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:len(where)]
    inside = np.arange(len(where)) + width <= bounds[1:][doc]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return [np.empty(0, np.int64)] * 4
    at = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    # Five bits hold a run's length.
    new |= (np.arange(len(starts)) - first[np.cumsum(new) - 1]) % 31 == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    run_doc = doc[starts[first]]
    return run_doc, starts[first] - bounds[run_doc], count, grams[at[first]].view(np.int64)


def _pack(text_hash, start, count):
    """One long that orders by text hash, then start: 31 + 27 + 5 bits."""
    return (text_hash << 32) | (start << 5) | count


def _find_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = lists(batch.column(2))
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in slices(np.diff(offsets), STEP_WORDS):
                part = words[offsets[lo]:offsets[hi]].view(np.uint64)
                doc, start, count, anchor = anchor_runs(part, offsets[lo:hi + 1] - offsets[lo], width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(ids[lo:hi][doc]), pa.array(_pack(texts[lo:hi][doc], start, count))],
                    ["anchor", "key", "pos"])
    return run


def _hash_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = lists(batch.column(2))
            runs = batch.column(3)
            run_offsets = runs.offsets.to_numpy()
            anchors, pos, salt = (runs.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in slices(np.diff(offsets), STEP_WORDS):
                base = offsets[lo]
                windows = rolling(words[base:offsets[hi]].view(np.uint64), width)
                a, b = run_offsets[lo], run_offsets[hi]
                doc = lo + np.repeat(np.arange(hi - lo), np.diff(run_offsets[lo:hi + 1]))
                own = (pos[a:b] >> 32) == texts[doc]
                doc, p, s, anchor = doc[own], pos[a:b][own], salt[a:b][own], anchors[a:b][own]
                count = p & 31
                first = offsets[doc] - base + ((p >> 5) & 0x7FFFFFF)
                ends = np.cumsum(count)
                flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)
                hashes = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(windows[flat].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(s), pa.array(ids[doc]), pa.array(p), hashes],
                    ["anchor", "salt", "key", "pos", "hashes"])
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (anchor, salt), in order of (key, pos): windows seen before, and first ones of salted anchors."""
    group, seen = None, {}
    for batch in batches:
        anchors, salts, keys, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        values, offsets = lists(batch.column(4))
        if not len(anchors):
            continue
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(anchors)), sizes)
        value = values[offsets[0]:offsets[-1]]
        start = ((pos >> 5) & 0x7FFFFFF)[row] + np.arange(len(value)) - (offsets[:-1] - offsets[0])[row]
        place = ((pos >> 32)[row] << 32) | start
        code = np.cumsum(np.concatenate([[0], (np.diff(anchors) != 0) | (np.diff(salts) != 0)]))[row]
        order = np.lexsort((np.arange(len(value)), value, code))
        same = np.zeros(len(value), bool)
        same[1:] = (value[order][1:] == value[order][:-1]) & (code[order][1:] == code[order][:-1])
        leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(value))))]
        first_key, first_place = np.empty_like(place), np.empty_like(place)
        first_key[order], first_place[order] = keys[row][leader], place[leader]
        if group == (anchors[0], salts[0]):  # the group goes on from the batch before
            for i in np.flatnonzero(code == 0):
                if (found := seen.get(int(value[i]))) is not None:
                    first_key[i], first_place[i] = found
        later = (first_key != keys[row]) | (first_place != place)
        if group != (anchors[-1], salts[-1]):
            seen = {}
        group = (anchors[-1], salts[-1])
        for i in np.flatnonzero((code == code[-1]) & ~later):
            seen.setdefault(int(value[i]), (int(keys[row[i]]), int(place[i])))
        # Later windows that follow one another are one interval.
        i = np.flatnonzero(later)
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 1) | (np.diff(row[i]) != 0)
        head = i[new]
        length = np.diff(np.append(np.flatnonzero(new), len(i)))
        lead = np.flatnonzero(~later & (salts[row] >= 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys[row[head]], keys[row[lead]]])),
             pa.array(np.concatenate([place[head], place[lead]])),
             pa.array(np.concatenate([length, np.ones(len(lead), length.dtype)])),
             pa.array(np.concatenate([np.zeros(len(head), np.int64), value[lead]]),
                      mask=np.concatenate([np.ones(len(head), bool), np.zeros(len(lead), bool)]))],
            ["key", "place", "n", "leads"])


def _keep(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(2).to_numpy(zero_copy_only=False)
            found = batch.column(3)
            out = []
            for i, raw in enumerate(text_bytes(batch.column(1))):
                words = raw.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if found[i].is_valid:
                    item = found[i].values
                    place, n = (item.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    own = (place >> 32) == hashes[i]
                    start = place[own] & 0xFFFFFFFF
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n[own] - 1 + width, -1)
                kept = np.cumsum(gone)[:-1] == 0
                left = words if kept.all() else [words[j] for j in np.flatnonzero(kept)]
                joined = b" ".join(left)
                row = (len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest())
                out.append((*row, joined.decode()) if with_text else row)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * (4 if with_text else 3)
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][:len(arrays)])
    return run


def dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text",
          with_text: bool = True) -> DataFrame:
    """Remove repeated passages of ``width`` words or more.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with
    ``with_text``, ``kept`` (kept words joined by one space). One row out per
    row in. A null text has no words; texts under ``width`` words keep all.
    Rows with one id and one text are the same document (the same result for
    each); rows with one id but different texts are different documents,
    ordered by a hash of their text. Null ids order before all others.
    ``doc_id`` must be integral; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Just these two columns, so that both joins by key share one exchange of the texts.
    keyed = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "text")
    text_hash = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))

    anchors = (keyed.select("key", text_hash.alias("h"), hashed.alias("words"))
               .mapInArrow(_find_anchors(width), "anchor bigint, key bigint, pos bigint"))
    # A table of its own: Spark splits a hot anchor's side of a join between plain exchanges only.
    counts = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    salts = F.ceil(F.col("n") / PER_TASK)
    salt = F.when(salts > 1, F.pmod(F.xxhash64("key", "pos"), salts)).otherwise(F.lit(-1)).cast("long")
    runs = (anchors.join(counts, "anchor")
            .groupBy("key").agg(F.collect_list(F.struct("anchor", "pos", salt.alias("salt"))).alias("runs")))

    windows = (keyed.join(runs, "key")
               .select("key", text_hash.alias("h"), hashed.alias("words"), "runs")
               .mapInArrow(_hash_windows(width),
                           "anchor bigint, salt bigint, key bigint, pos bigint, hashes array<bigint>"))
    found = (windows.repartition("anchor", "salt")
             .sortWithinPartitions("anchor", "salt", "key", "pos")
             .mapInArrow(_repeats, "key bigint, place bigint, n bigint, leads bigint"))
    first = W.partitionBy("leads").orderBy("key", "place")
    between = (found.where("leads is not null")
               .withColumn("before", F.dense_rank().over(first)).where("before > 1"))
    removed = (found.where("leads is null").select("key", "place", "n")
               .unionByName(between.select("key", "place", "n"))
               .groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("removed")))

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return (keyed.join(removed, "key", "left")
            .select(F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "text", text_hash.alias("h"), "removed")
            .mapInArrow(_keep(width, with_text), schema + (", kept string" if with_text else "")))
