"""Benchmark decontamination by greedy string tiling.

Documents that share a seed (``seed`` consecutive tokens) with a benchmark
item are candidates. For each candidate pair, tiling marks the longest common
run of tokens neither side of which is marked yet, again and again, down to
runs of ``seed`` tokens; runs are found by the rolling hash of their seeds and
then compared token by token. The share of the item's tokens under tiles is
its coverage, which does not depend on the order of the passages.

Tokens are words, A-Z lower-cased, ASCII punctuation taken as space. An item
under ``seed`` tokens is its own seed.

Seeds of both sides meet in a shuffled join on their hash, so neither table is
held whole anywhere. Equal texts are one text, named by a digest. What keeps
the join small, without losing a pair:

* a bitmap of the benchmark's seeds, of bounded size, drops the documents'
  other seeds before the shuffle;
* a tile's tokens lie under shared seeds, so a covered item shares at least
  ``coverage * tokens / seed`` of its seed places with the document. One place
  fewer than that, of the seeds that most documents hold, need not be joined,
  and a pair with fewer shared places need not be tiled;
* a seed that is still held by very many documents is split by a salt.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import Numbering, fresh, slices, text_bytes, written
from cellpulse.operators.prune import keep_keys
from cellpulse.session import bounded_broadcast

SEED = 5
COVERAGE = 0.8
STEP_BYTES = 4 << 20
#: Bits of the bitmap of the benchmark's seeds: this many a seed, and at most 16 MB in all.
SEED_BITS, MOST_BITS = 64, 1 << 27
#: A seed held by more documents than this is split; at most ``HOT_SEEDS`` are (the bound rises with the table).
HOT, HOT_SEEDS = 20_000, 100_000
#: Items tiled against one copy of a document: as many bytes as the document has, but at least this.
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_PUNCTUATION).split()


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` ids (Karp-Rabin; for few tokens, summed directly)."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for j in range(size):
        out = out * BASE + ids[j:j + len(out)].astype(np.uint64) + np.uint64(2)
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    """High bits depend on all bits: for sorted look-ups and few collisions."""
    x = values ^ (values >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


def _seed_ids(doc: np.ndarray, item: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A number per start in ``doc`` and ``item``, equal where the same ``seed`` tokens start; -1 in ``doc`` for others.

    Found by rolling hash, then compared token by token: equal hashes are not proof.
    """
    of_doc, of_item = _hashes(doc, seed), _hashes(item, seed)
    ids, found = np.full(len(of_item), -1), np.full(len(of_doc), -1)
    places, todo, count = np.flatnonzero(np.isin(of_doc, of_item)), np.arange(len(of_item)), 0
    doc_seeds, item_seeds = sliding_window_view(doc, seed), sliding_window_view(item, seed)
    while len(todo):  # once, but for two seeds of one hash
        known, first, group = np.unique(of_item[todo], return_index=True, return_inverse=True)
        example = todo[first]
        same = (item_seeds[todo] == item_seeds[example[group]]).all(axis=1)
        ids[todo[same]] = count + group[same]
        at = np.minimum(np.searchsorted(known, of_doc[places]), len(known) - 1)
        equal = (doc_seeds[places] == item_seeds[example[at]]).all(axis=1)
        found[places[equal]] = count + at[equal]
        count, todo = count + len(known), todo[~same]
    return found, ids


def _edges(here: np.ndarray, there: np.ndarray, starts: list[np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
    """(start in doc, start in item) of equal seeds that have none ``step`` further on in both.

    ``here`` and ``there`` are the seed's number and that of its neighbour at each start in doc. Places with
    the same two seeds have the same answer, which is worked out once.
    """
    places = np.flatnonzero(here >= 0)
    kinds, kind = np.unique(here[places] * (len(starts) + 1) + there[places] + 1, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
    p, q = [], []
    for i, k in enumerate(kinds.tolist()):
        own, near = divmod(k, len(starts) + 1)
        at = starts[own] if not near else np.setdiff1d(starts[own], starts[near - 1] - step, assume_unique=True)
        if len(at):
            group = places[order[bounds[i]:bounds[i + 1]]]
            p.append(np.repeat(group, len(at)))
            q.append(np.tile(at, len(group)))
    none = np.empty(0, np.int64)
    p, q = np.concatenate([none, *p]), np.concatenate([none, *q])
    order = np.lexsort((p, p - q))
    return p[order], q[order]


def tiles(doc: np.ndarray, item: np.ndarray, seed: int, least: float = 0) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first.

    Ties go to the smaller start in ``doc``, then in ``item``. Common runs are
    found by their ends, so repeated tokens cost no more than the runs they
    make. No tiles are looked for if the item's tokens under any shared seed
    are fewer than ``least``: tiles lie under shared seeds.
    """
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return []
    here, ids = _seed_ids(doc, item, seed)
    shared = np.zeros(len(item) + 1, np.int64)
    held = np.flatnonzero(np.isin(ids, here))
    np.add.at(shared, held, 1)
    np.add.at(shared, held + seed, -1)
    if not len(held) or np.count_nonzero(np.cumsum(shared)) < least:
        return []
    order = np.argsort(ids, kind="stable")
    starts = np.split(order, np.flatnonzero(np.diff(ids[order])) + 1)
    edge = np.array([-1])
    p, first_q = _edges(here, np.concatenate([edge, here[:-1]]), starts, -1)
    last_p, _ = _edges(here, np.concatenate([here[1:], edge]), starts, 1)
    length = last_p - p + seed  # per diagonal, the runs' starts and ends come in turn
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), p.tolist(), first_q.tolist())]
    heapq.heapify(heap)
    doc_marked, item_marked, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(doc_marked[a:a + n] | item_marked[b:b + n])
        if free.all():
            doc_marked[a:a + n] = item_marked[b:b + n] = True
            out.append((a, b, n))
            if not (sliding_window_view(item_marked, seed).sum(axis=1) == 0).any():
                break  # no room for a tile is left
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for lo, hi in edge.reshape(-1, 2).tolist():
            if hi - lo >= seed:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return out


def _key(text: Column) -> Column:
    """Digest that stands for a text (null for null)."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of the rows that have a text."""
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.where(F.length("text") > 0).select(_key(F.col("text")).alias("key"), "text")


def _runs(ids: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = row[size - 1:] == row[:len(row) - size + 1]
    hashed = _mixed(_hashes(ids, size) + np.uint64(size))
    return row[:len(inside)][inside], hashed[inside].view(np.int64)


def _item_seeds(seed: int):
    """Per item and distinct seed: its hash, its places in the item, the item's tokens and the seed's size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in enumerate(text_bytes(batch.column(1))):
                words = tokens(raw)
                size = min(seed, len(words))
                if not size:
                    continue
                ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                hashed, places = np.unique(_runs(ids, np.zeros(len(ids), np.int64), size)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[at], len(hashed)), pa.array(hashed), pa.array(places.astype(np.int64)),
                     pa.repeat(pa.scalar(len(words), pa.int64()), len(hashed)), pa.repeat(pa.scalar(size, pa.int32()), len(hashed))],
                    ["item", "hash", "places", "n", "size"])
    return run


def _doc_seeds(shared, sizes: list[int]):
    """Per document and distinct seed in the bitmap: key, hash, bytes of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        mask = np.int64(len(bitmap) * 8 - 1)
        for batch in batches:
            texts = list(text_bytes(batch.column(1)))
            lengths = np.array([len(t) for t in texts], np.int64)
            for lo, hi in slices(lengths, STEP_BYTES):
                parts = [tokens(t) for t in texts[lo:hi]]
                counts = np.array([len(p) for p in parts], np.int64)
                ids = np.fromiter((xxhash.xxh3_64_intdigest(w) for p in parts for w in p), np.uint64, int(counts.sum()))
                of = np.repeat(np.arange(lo, hi), counts)
                for size in sizes:
                    row, hashed = _runs(ids, of, size)
                    slot = hashed & mask
                    held = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    pairs = np.unique(np.stack([row[held], hashed[held]], axis=1), axis=0)
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1]), pa.array(lengths[pairs[:, 0]])],
                            ["doc", "hash", "bytes"])
    return run


def _bitmap(seeds: DataFrame, count: int) -> bytes:
    """One bit per slot of the seeds' hashes; its size is bounded by ``MOST_BITS``."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (SEED_BITS * count - 1).bit_length()))
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bitmap functions count from 1
    parts = (seeds.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))
    out = bytearray(bits // 8)
    for row in parts.toLocalIterator():
        out[(row["part"] - 1) * 4096:row["part"] * 4096] = row["bits"]
    return bytes(out)


def _pairs(docs: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame | None:
    """(doc, item, bytes): texts that share enough seeds for the item to be covered; None if there are no seeds."""
    spark = docs.sparkSession
    known = written(items.mapInArrow(_item_seeds(seed), "item binary, hash bigint, places bigint, n bigint, size int"), "item_seeds")
    sizes = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}
    if not sizes:
        return None
    shared = spark.sparkContext.broadcast(_bitmap(known, sum(sizes.values())))
    found = docs.mapInArrow(_doc_seeds(shared, sorted(sizes)), "doc binary, hash bigint, bytes bigint")
    hits = written(found.distinct(), "doc_seeds")

    # Of each item's seeds, ordered by how many documents hold them, all that a covering document could do without go.
    holders = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("holders"))
    need = F.greatest(F.ceil(F.col("n") * F.lit(float(coverage)) / F.col("size") - F.lit(1e-9)), F.lit(1))
    most_held = Window.partitionBy("item").orderBy(F.desc("holders"), "hash").rowsBetween(Window.unboundedPreceding, 0)
    kept = (known.join(holders, "hash").withColumns({"need": need, "running": F.sum("places").over(most_held)})
            .where(F.col("running") >= F.col("need")))
    # Places left out before the first seed that stays.
    left_out = F.min(F.col("running") - F.col("places")).over(Window.partitionBy("item"))
    kept = written(kept.select("item", "hash", "places", "holders", (F.col("need") - left_out).alias("need")), "joined_seeds")

    most = max(HOT, hits.count() // HOT_SEEDS)
    hot = (kept.where(F.col("holders") > most).groupBy("hash")
           .agg(F.ceil(F.max("holders") / F.lit(most)).cast("int").alias("ways")))
    hot = F.broadcast(hot)  # at most HOT_SEEDS rows of 12 bytes: more seeds cannot have as many holders
    ways = F.coalesce("ways", F.lit(1))
    here = hits.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), ways).cast("int"))
    there = kept.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    met = here.select("doc", "hash", "salt", "bytes").join(there.select("item", "hash", "salt", "places", "need"), ["hash", "salt"])
    return (met.groupBy("doc", "item").agg(F.max("bytes").alias("bytes"), F.sum("places").alias("places"), F.max("need").alias("need"))
            .where(F.col("places") >= F.col("need")).select("doc", "item", "bytes"))


def _covered(docs: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame | None:
    """(doc, item, tiled, item_tokens) of the distinct texts that cover an item, as a written table."""
    pairs = _pairs(docs, items, seed, coverage)
    if pairs is None:
        return None
    pairs = written(pairs, "shared_seeds")
    tests = keep_keys(items, pairs.select(F.col("item").alias("key")).distinct(), "key").dropDuplicates(["key"])
    texts = keep_keys(docs, pairs.select(F.col("doc").alias("key")).distinct(), "key").dropDuplicates(["key"])
    # A document goes out once for each chunk of its items; a chunk has about the bytes of the document.
    before = Window.partitionBy("doc").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum(F.octet_length("test")).over(before), F.lit(0)) / F.greatest("bytes", F.lit(CHUNK_BYTES)))
    listed = (pairs.join(tests.select(F.col("key").alias("item"), F.col("text").alias("test")), "item").withColumn("chunk", chunk)
              .groupBy("doc", "chunk").agg(F.collect_list(F.struct("item", "test")).alias("tests")))
    work = listed.join(texts.select(F.col("key").alias("doc"), "text"), "doc").select("doc", "text", "tests")
    return written(work.mapInArrow(_tiler(seed, coverage), "doc binary, item binary, tiled bigint, item_tokens bigint"), "covered")


def _tiler(seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tests, found = batch.column(0), batch.column(2), []
            for at, raw in enumerate(text_bytes(batch.column(1))):
                number = Numbering()
                words = tokens(raw)
                doc = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                for test in tests[at].as_py():
                    words = tokens(test["test"].encode())
                    item = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    tiled = sum(n for _, _, n in tiles(doc, item, seed, coverage * len(item)))
                    if tiled >= coverage * len(item):
                        found.append((keys[at].as_py(), test["item"], tiled, len(item)))
            if found:
                doc, item, tiled, size = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.binary()), pa.array(item, pa.binary()), pa.array(tiled, pa.int64()), pa.array(size, pa.int64())],
                    ["doc", "item", "tiled", "item_tokens"])
    return run


def matches(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text") -> DataFrame:
    """Every document and item of which tiles cover at least ``coverage`` of the item.

    Returns ``doc_id``, ``item_id``, ``tiled``, ``item_tokens`` (longs) and
    ``coverage``: a row per pair, repeated for repeated rows on either side.
    Null and empty texts, and items without tokens, match nothing. Null ids
    are passed on. Empty tables on either side give an empty result. Other
    columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _key(F.col(f"`{text_col}`").cast("string")).alias("doc"))
    tests = items.select(F.col(f"`{item_col}`").alias("item_id"), _key(F.col(f"`{item_text_col}`").cast("string")).alias("item"))
    found = _covered(_texts(docs, text_col), _texts(items, item_text_col), seed, coverage)
    if found is None:
        schema = f"doc_id {rows.dtypes[0][1]}, item_id {tests.dtypes[0][1]}, tiled bigint, item_tokens bigint, coverage double"
        return docs.sparkSession.createDataFrame([], schema)
    # Found pairs first meet the items, then the documents: copies of a text are rows of the result, no earlier.
    named = found.join(tests, "item").select("doc", "item_id", "tiled", "item_tokens")
    return rows.join(named, "doc").select("doc_id", "item_id", "tiled", "item_tokens",
                                          (F.col("tiled") / F.col("item_tokens")).alias("coverage"))


def keep_clean(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that cover no item; all columns are kept.

    Rows are told apart by their text, not by id. Null and empty texts stay, repeated rows
    and null ids are judged like any other; an empty table on either side changes nothing.
    """
    found = _covered(_texts(docs, text_col), _texts(items, "text"), seed, coverage)
    if found is None:
        return docs
    (name,) = fresh(docs.columns, "__key")
    dirty = bounded_broadcast(written(found.select(F.col("doc").alias(name)).distinct(), "dirty"))
    rows = docs.withColumn(name, _key(F.col(f"`{text_col}`").cast("string")))
    return rows.join(dirty, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
