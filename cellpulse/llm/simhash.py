"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits form a ring of eight segments of one byte. Two
fingerprints within ``BITS`` = 3 differing bits have, by the pigeonring
principle, a segment from which every chain of ``l`` consecutive segments
differs in at most ``l * 3 / 8`` bits: nothing in the first two, one bit in
the first five, two in the first seven, three in all. So from that segment on,
the first two and at least two of the next three are equal. Those four
segments (32 bits, 8 starts x 3 choices of the third left out) are the join
key; within a bucket the whole chain is tested before the full distance.

Buckets hold distinct fingerprints, so exact copies meet only once. A bucket
is searched breadth first: each member found is compared only with those not
found yet, and the bucket yields one link per member, not its pairs. Buckets
over ``BUCKET`` members are cut into blocks, and every two blocks meet in a
task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import fresh, text_bytes
from cellpulse.llm.components import components
from cellpulse.session import materialize

SHINGLE = 3
BITS = 3
SEED = 42
SEGMENTS = 8
#: Fingerprints of one bucket (8 bytes each) that one task searches.
BUCKET = 32_768
#: Shingles hashed before their bits are counted.
STEP = 200_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words; fewer words are one shingle."""
    # bytes.lower() and bytes.split() know just A-Z and the six ASCII spaces.
    words = text.lower().split()
    if not words:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hashed(b" ".join(words), SEED)]
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[:len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1:].tolist(), len(joined)]
    return [hashed(joined[a:b], SEED) for a, b in zip(starts, ends)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint per document of ``sizes`` consecutive hashes: bits set in over half."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum(sizes) - sizes
        ones = np.add.reduceat(bits, starts[some], axis=0, dtype=np.int32)
        over = 2 * ones > sizes[some][:, None]
        out[some] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): fingerprint of the column ``text``; the others are passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, pending, sizes, total = [], [], [], 0

            def settle():
                if sizes:
                    flat = np.fromiter((h for doc in pending for h in doc), np.uint64, total)
                    fps.append(majority(flat, np.array(sizes)))

            for raw in text_bytes(batch.column(2)):
                hashes = shingle_hashes(raw, size)
                if total and total + len(hashes) > STEP:
                    settle()
                    pending, sizes, total = [], [], 0
                pending.append(hashes)
                sizes.append(len(hashes))
                total += len(hashes)
            settle()
            fp = np.concatenate(fps) if fps else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    return rows.select("doc_id", "h", "text").mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _rotated(fp: Column, start: int) -> Column:
    """``fp`` turned left until segment ``start`` is on top."""
    if not start:
        return fp
    return F.shiftleft(fp, 8 * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * start))


def bucket_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: start and left-out segment above 40 bits of four segments."""
    keys = []
    for start in range(SEGMENTS):
        top = F.shiftrightunsigned(_rotated(fp, start), 24)
        for out, mask in enumerate((0xFFFF00FFFF, 0xFFFFFF00FF, 0xFFFFFFFF00)):
            tag = (start * 3 + out) << 40
            keys.append(top.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


def near(a: np.ndarray, b: np.ndarray, start: int, bits: int = BITS) -> np.ndarray:
    """Chain budgets from segment ``start`` on, then the full distance, for a against b."""
    x = a ^ b
    if start:
        x = (x << np.uint64(8 * start)) | (x >> np.uint64(64 - 8 * start))
    ok = np.ones(x.shape, bool)
    for length in range(2, SEGMENTS + 1):
        if length < SEGMENTS and (length + 1) * bits // SEGMENTS == length * bits // SEGMENTS:
            continue  # the longer chain has the same budget
        ok &= np.bitwise_count(x >> np.uint64(64 - 8 * length)) <= length * bits // SEGMENTS
        if not ok.any():
            break
    return ok


def bucket_links(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """(member, smallest-found root) links that connect what is near within one bucket."""
    links, left = [], np.unique(members)
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 64):
                rest = np.flatnonzero(~hit)
                for lo in range(0, len(rest), 16_384):
                    part = rest[lo:lo + 16_384]
                    hit[part] |= near(frontier[at:at + 64, None], left[part][None, :], start).any(axis=0)
            frontier, left = left[hit], left[~hit]
            links.extend((int(root), int(x)) for x in frontier)
    return links


def _search_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each (key, block pair), whose rows follow one another."""
    rest: list[np.ndarray] = [np.empty(0, np.int64)] * 3

    def search(keys, blocks, fps):
        cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0)) + 1
        cut = np.concatenate([[0], cut, [len(keys)]])
        sizes = np.diff(cut)
        found: list[np.ndarray] = []
        # Buckets of two are most of them: all at once.
        two = cut[:-1][sizes == 2]
        starts = (keys[two] >> 40) // 3
        for start in np.unique(starts):
            a, b = fps[two[starts == start]], fps[two[starts == start] + 1]
            ok = near(a, b, int(start))
            found.append(np.stack([a[ok], b[ok]], axis=1))
        for i in np.flatnonzero(sizes > 2):
            links = bucket_links(fps[cut[i]:cut[i + 1]], int(keys[cut[i]] >> 40) // 3)
            if links:
                found.append(np.array(links, np.uint64))
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
        pairs = np.unique(pairs, axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        rest = [np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False)])
                for i, old in enumerate(rest)]
        keys, blocks, fps = rest
        if not len(keys):
            continue
        last = np.flatnonzero((keys != keys[-1]) | (blocks != blocks[-1]))
        done = last[-1] + 1 if len(last) else 0
        if done:
            yield search(keys[:done], blocks[:done], fps[:done].view(np.uint64))
        rest = [keys[done:], blocks[done:], fps[done:]]
    if len(rest[0]):
        yield search(rest[0], rest[1], rest[2].view(np.uint64))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) with the same components as all pairs within ``BITS`` bits.

    ``fps`` has one column ``fp`` of distinct fingerprints.
    """
    keys = fps.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / bucket)
    mine = F.pmod(F.xxhash64("fp"), blocks)
    # Block pairs (p, q), p < q, as p * blocks + q: all that hold the row's own block.
    pairs = F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: x != mine),
                    lambda x: F.least(x, mine) * blocks + F.greatest(x, mine)))
    dealt = (keys.join(sizes, "key").select("key", F.explode(pairs).alias("block"), "fp")
             .repartition("key", "block").sortWithinPartitions("key", "block", "fp"))
    return dealt.mapInArrow(_search_buckets, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of every row.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``
    (smallest id reachable over links of at most ``BITS`` differing bits) and
    ``h`` (hash of the text). One row out per row in. Null, empty and blank
    texts have fingerprint zero and are linked like any other. A null id takes
    part but is never a component's id, unless all its members' are null.
    Repeated rows share a component. ``doc_id`` must be integral; other
    columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    marked = materialize(fingerprints(rows, size))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    placed = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "h")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id (null last), then text hash, of each component.

    Of repeated rows one stays. All columns are kept, whatever their names.
    Null, empty and blank texts are texts like any other; an empty table stays empty.
    """
    row_id, row_h, kept_id, kept_h = fresh(docs.columns, "row_id", "row_h", "kept_id", "kept_h")
    found = near_duplicates(docs, id_col, text_col)
    kept = (found.groupBy(F.coalesce("component_id", F.lit(-1)).alias("c"), F.col("component_id").isNull().alias("none"))
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first"))
            .select(F.col("first.doc_id").alias(kept_id), F.col("first.h").alias(kept_h)))
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    keyed = docs.withColumn(row_id, F.col(id_col).cast("long")).withColumn(row_h, text_hash)
    same = keyed[row_id].eqNullSafe(kept[kept_id]) & (keyed[row_h] == kept[kept_h])
    return keyed.join(kept, same, "left_semi").dropDuplicates([row_id, row_h]).drop(row_id, row_h)
