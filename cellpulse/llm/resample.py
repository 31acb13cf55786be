"""Importance resampling towards a target distribution.

Runs of words are hashed into buckets. Two arrays, the bucket counts of the
corpus and of the target texts, give a third: the *gain* of each bucket, the
logarithm of how much likelier it is in the target. A document's weight is
the sum of its features' gains; with Gumbel noise from its id added, the
highest scores are a sample drawn without replacement by these weights.

The cutoff score is selected, not sorted for: each partition reports the
median of the keys it still holds and how many they are. The weighted median
of these medians has at least a quarter of the remaining keys on either side,
so one count on either side of it discards a quarter at least, until the key
of the wanted rank itself is the pivot. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import text_bytes, written
from cellpulse.session import bounded_broadcast

#: Buckets of the hashed features.
BUCKETS = 10_000
#: Words whose bucket a task remembers.
FEATURE_MEMORY = 500_000
#: Keys of a partition of the shrinking table of candidates.
KEYS_PER_PARTITION = 2_000_000

#: A-Z lower-cased; every byte that is no word character becomes a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(raw: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, with A-Z lower-cased."""
    return raw.translate(_WORD_BYTES).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, repeats included."""
    out = words
    for n in range(2, longest + 1):
        out = out + [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


class _Buckets(dict):
    """Bucket of each feature, remembered until there are too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= FEATURE_MEMORY:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket

    def look_up(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket.

    A task sends its own counts, one row per bucket at most, and Spark adds
    them up; the result is an array of ``buckets`` numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashed = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                found = hashed.look_up(features_of(words_of(raw), longest))
                if len(found):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket."""
    s_all, t_all, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: str, key) -> int:
    """floor(1000 x a Gumbel variate) from the sha256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str, id_col: str = "doc_id", text_col: str = "text",
           longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Buckets(buckets)
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(raw)
                found = hashed.look_up(features_of(words, longest))
                weight = int(gain[found].sum()) if len(found) else 0
                out.append((len(words), len(found), weight, weight + noise(seed, key)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


# --- selection -----------------------------------------------------------------

#: Order of a null id: after all others of its score.
_LAST = 2 ** 63 - 1


def _order(score: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.lexsort((key, -score))


def _report(pivot: tuple[int, int] | None):
    """Per partition: of the keys before and after the pivot, how many and the median; how many are the pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        out = []
        if held:
            score, key = (np.concatenate(x) for x in zip(*held))
            if pivot is None:
                sides = {"before": np.ones(len(score), bool)}
            else:
                same = (score == pivot[0]) & (key == pivot[1])
                before = (score > pivot[0]) | ((score == pivot[0]) & (key < pivot[1]))
                sides = {"before": before, "same": same, "after": ~(before | same)}
            for side, mask in sides.items():
                n = int(mask.sum())
                if n:
                    s, k = score[mask], key[mask]
                    mid = _order(s, k)[(n - 1) // 2]
                    out.append((side, n, int(s[mid]), int(k[mid])))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string())] + [pa.array(c, pa.int64()) for c in columns[1:]],
                                         ["side", "n", "score", "key"])
    return run


def weighted_median(medians: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Of (size, score, key): the key with half of the sizes at or before it, in selection order."""
    left = (sum(n for n, _, _ in medians) + 1) // 2
    for n, score, key in sorted(medians, key=lambda m: (-m[1], m[2])):
        left -= n
        if left <= 0:
            return score, key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, wanted: int) -> tuple[int, int, int, int]:
    """The key of rank ``wanted`` (from 1) among (score, key), highest score and then smallest key first.

    Returns score, key, how many keys come before it, and the rounds taken.
    A round is one job; it returns two medians per partition. The keys that
    are left are written anew whenever they have become a quarter, so all
    rounds together read little more than the first two.
    """
    def ask(pivot):
        rows = left.mapInArrow(_report(pivot), "side string, n bigint, score bigint, key bigint").collect()
        found = {side: [(r["n"], r["score"], r["key"]) for r in rows if r["side"] == side] for side in ("before", "same", "after")}
        return found, {side: sum(n for n, _, _ in ms) for side, ms in found.items()}

    left = keys.select("score", "key")
    found, sizes = ask(None)
    medians, remaining, stored, passed, rounds = found["before"], sizes["before"], sizes["before"], 0, 1
    if not 1 <= wanted <= remaining:
        raise ValueError(f"rank {wanted} of {remaining} keys")
    while True:
        pivot = weighted_median(medians)
        score, key = pivot
        found, sizes = ask(pivot)
        rounds += 1
        if passed + sizes["before"] >= wanted:
            medians, remaining = found["before"], sizes["before"]
            side = (F.col("score") > score) | ((F.col("score") == score) & (F.col("key") < key))
        elif passed + sizes["before"] + sizes["same"] >= wanted:
            return score, key, passed + sizes["before"], rounds
        else:
            passed += sizes["before"] + sizes["same"]
            medians, remaining = found["after"], sizes["after"]
            side = (F.col("score") < score) | ((F.col("score") == score) & (F.col("key") > key))
        left = left.where(side)
        if remaining * 4 <= stored:
            left = written(left.coalesce(1 + remaining // KEYS_PER_PARTITION), "resample-keys")
            stored = remaining


def _ranked(winners: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 1) in selection order, without a step over all rows.

    The rows are range-sorted and written; each file's rows are numbered in
    place and the counts of the partitions before are added: one row per
    partition.
    """
    ordered = winners.orderBy(F.col("score").desc(), "key").withColumn("__at", F.monotonically_increasing_id())
    ordered = written(ordered, "resample-winners").withColumns({
        "__part": F.shiftright("__at", 33), "__pos": F.col("__at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    most = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ordered.join(bounded_broadcast(starts, known_bytes=64 * most), "__part")
            .withColumn("rank", F.col("__before") + F.col("__pos") + 1).drop("__at", "__part", "__pos", "__before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: str = "2024",
             longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Draw ``percent`` % of the documents with ``min_words`` words, by how like the target texts they are.

    Returns ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of
    every row; ``rank`` is 1, 2, 3... for those drawn, highest score first and
    smaller id first among equals, else null. A null or wordless text has no
    features and weight 0. A null id is hashed as an empty one and comes last
    among equal scores; of rows alike in id and score any may be the one drawn.
    Repeated rows count and are judged one by one. An empty table gives an
    empty result, an empty target weights by the corpus alone; other columns
    are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    rows = written(scored(docs, gain, seed, id_col, text_col, longest), "resample-scored")
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    able = rows.where(F.col("n_words") >= min_words)
    wanted = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if wanted == 0:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    score, key, before, _ = cutoff(able, wanted)
    ahead = (F.col("n_words") >= min_words) & (
        (F.col("score") > score) | ((F.col("score") == score) & (F.col("key") <= key)))
    ranked = _ranked(rows.where(ahead))
    # Rows that are the cutoff key itself: as many as are wanted still.
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where(~ahead).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))
