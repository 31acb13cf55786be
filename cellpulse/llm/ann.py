"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (random signs and a
Walsh-Hadamard transform, three times) and go to the nearest signed axis.
Two such axes are a bucket of one of ``TABLES`` tables. A query probes each
table's buckets from the likeliest on: ``PROBES`` of them, and as many more as
it takes to reach ``MIN_POINTS`` vectors. All vectors in a probed bucket are
compared exactly, in double precision, with the original query.

Every vector is in every table. Equal vectors are one entry, which carries
its smallest ids (no query can need more); a table's first axis, cut into
blocks of at most ``BLOCK`` entries, is what one task searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellpulse.llm.common import lists, written

NEIGHBOURS = 20
TABLES = 8
PROBES = 300
MIN_POINTS = 1_500
BLOCK = 20_000
SEED = 11
#: Queries compared with a block at a time.
STEP = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row (a power of two long)."""
    n, size, width = x.shape[0], x.shape[1], 1
    while width < size:
        x = x.reshape(n, -1, 2, width)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        width *= 2
    return x / np.sqrt(size)


@lru_cache(maxsize=16)
def _corner(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) below ``size`` with (i + 1) * (j + 1) <= n."""
    widths = np.minimum(n // np.arange(1, min(n, size) + 1), size)
    i = np.repeat(np.arange(len(widths)), widths)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(widths) - widths, widths)


class Counts:
    """Vectors per bucket of each table, for the buckets that hold any."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, signed: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.signed = keys[order], counts[order], signed

    def table(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a table that hold vectors, and how many."""
        lo, hi = np.searchsorted(self.keys, [table * self.signed ** 2, (table + 1) * self.signed ** 2])
        return self.keys[lo:hi] - table * self.signed ** 2, self.counts[lo:hi]

    def of(self, table: int, buckets: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(buckets), np.int64)
        keys = table * self.signed ** 2 + buckets
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


class CrossPolytope:
    """The rotations of all tables for vectors of ``size`` components.

    ``longest`` is 0 if all vectors have one length; else vectors are scaled
    by it and get one more component that makes them unit vectors, so that the
    largest inner product is the smallest angle.
    """

    def __init__(self, size: int, longest: float, tables: int = TABLES, seed: int = SEED):
        self.longest, self.tables = longest, tables
        self.axes = 1 << max(1, int(np.ceil(np.log2(max(2, size + (longest > 0))))))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, self.axes))

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.axes))
        if self.longest and not query:
            out[:, :x.shape[1]] = x / self.longest
            out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (out ** 2).sum(axis=1)))
        else:
            out[:, :x.shape[1]] = x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))
        return out

    def turned(self, unit: np.ndarray, table: int, half: int) -> np.ndarray:
        for signs in self.signs[table, half]:
            unit = hadamard(unit * signs)
        return unit

    def buckets(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest signed axis (axis * 2 + positive) of either rotation."""
        out = []
        for half in (0, 1):
            y = self.turned(unit, table, half)
            axis = np.abs(y).argmax(axis=1)
            out.append(axis * 2 + (y[np.arange(len(y)), axis] > 0))
        return out[0], out[1]

    def probes(self, unit: np.ndarray, table: int, counts: Counts, least: int, points: int) -> np.ndarray:
        """Buckets (first * 2 axes + second) one query probes in a table, likeliest first.

        The ``n`` likeliest are among the pairs of the i-th best first and the
        j-th best second axis with i * j <= n, so only those are compared.
        """
        signed = 2 * self.axes
        a, b = (np.stack([-y, y], axis=1).ravel() for y in
                (self.turned(unit[None, :], table, 0)[0], self.turned(unit[None, :], table, 1)[0]))
        by_a, by_b, n = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable"), min(max(least, 1), signed ** 2)
        known, members = counts.table(table)
        while True:
            i, j = _corner(n, signed)
            i, j = by_a[i], by_b[j]
            bucket = i * signed + j
            bucket = bucket[np.lexsort((bucket, -(a[i] + b[j])))[:n]]
            held = counts.of(table, bucket)
            total = np.cumsum(held)
            if total[-1] >= points or n == signed ** 2:
                last = max(least, int(np.searchsorted(total, points)) + 1)
                return bucket[:last][held[:last] > 0]
            if 2 * n >= len(known):  # fewer to rank: the buckets that hold any
                order = np.lexsort((known, -(a[known // signed] + b[known % signed])))
                return known[order[:int(np.searchsorted(np.cumsum(members[order]), points)) + 1]]
            n = min(2 * n, signed ** 2)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat, offsets = lists(column)
    return flat[offsets[0]:offsets[-1]].astype(np.float64).reshape(-1, size)


def _index(hashing: CrossPolytope, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = hashing.unit(_matrix(batch.column(1), size), query=False)
            for table in range(hashing.tables):
                first, second = hashing.buckets(unit, table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table * 2 * hashing.axes + first, pa.int32()), pa.array(second, pa.int32()),
                     batch.column(0), batch.column(1)], ["g", "second", "ids", "embedding"])
    return run


def _probe(hashing: CrossPolytope, size: int, shared, least: int, points: int):
    signed = 2 * hashing.axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value, signed)
        for batch in batches:
            unit = hashing.unit(_matrix(batch.column(1), size), query=True)
            row, g, probes = [], [], []
            for i in range(len(unit)):
                for table in range(hashing.tables):
                    chosen = hashing.probes(unit[i], table, counts, least, points)
                    for first in np.unique(chosen // signed):
                        row.append(i)
                        g.append(table * signed + int(first))
                        probes.append(np.sort(chosen[chosen // signed == first] % signed).astype(np.int32))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int32()), batch.column(0).take(at), pa.array(probes, pa.list_(pa.int32())),
                 batch.column(1).take(at)], ["g", "q", "probes", "embedding"])
    return run


def dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * query[j]
    return total


def _search(size: int, signed: int, keep: int):
    schema = pa.schema([("q", pa.int64()), ("t", pa.int32()), ("scores", pa.list_(pa.float64())), ("found", pa.list_(pa.int64()))])

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return schema.empty_table()
        points, queries = points.combine_chunks(), queries.combine_chunks()
        table = points["g"][0].as_py() // signed
        x, y = _matrix(points["embedding"], size), _matrix(queries["embedding"], size)
        second = points["second"].to_numpy()
        members, member_offsets = lists(points["ids"])
        probes, probe_offsets = lists(queries["probes"])
        ids = queries["q"].to_numpy()
        least = members[member_offsets[:-1]]
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(y), STEP):
            part = y[lo:lo + STEP]
            asked = np.zeros((len(part), signed), bool)
            for i in range(len(part)):
                asked[i, probes[probe_offsets[lo + i]:probe_offsets[lo + i + 1]]] = True
            rough = np.where(asked[:, second], part @ x.T, -np.inf)
            for i in range(len(part)):
                # Some to spare: the product may round otherwise than dot().
                some = np.flatnonzero(rough[i] > -np.inf)
                if len(some) > keep + 4:
                    bound = np.partition(rough[i][some], -(keep + 4))[-(keep + 4)]
                    some = some[rough[i][some] >= bound - 1e-9 * abs(bound)]
                score = dot(x[some], part[i])
                order = np.lexsort((least[some], -score))[:keep]
                some, score = some[order], score[order]
                n = np.diff(member_offsets)[some]
                every = np.concatenate([members[member_offsets[s]:member_offsets[s + 1]] for s in some] or [least[:0]])
                each = np.repeat(score, n)
                order = np.lexsort((every, -each))[:keep]
                if len(order):
                    out.append((int(ids[lo + i]), table, each[order], every[order]))
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _merge(keep: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        scores, a = lists(rows["scores"])
        found, b = lists(rows["found"])
        scores, found = scores[a[0]:a[-1]], found[b[0]:b[-1]]
        table = np.repeat(rows["t"].to_numpy(), np.diff(a))
        # A table holds a vector once: what is there again, as the same id and score, is another vector of that
        # id. The n-th of an id and score in one table is the n-th in all.
        order = np.lexsort((table, found, -scores))
        scores, found, table = scores[order], found[order], table[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (scores[1:] != scores[:-1]) | (table[1:] != table[:-1])
        at = np.arange(len(found))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        order = np.lexsort((nth, found, -scores))
        scores, found, nth = scores[order], found[order], nth[order]
        new[1:] = (found[1:] != found[:-1]) | (scores[1:] != scores[:-1]) | (nth[1:] != nth[:-1])
        order = np.flatnonzero(new)[:keep]
        return pa.table({"q": rows["q"][:1], "scores": pa.array([scores[order]], pa.list_(pa.float64())),
                         "found": pa.array([found[order]], pa.list_(pa.int64()))})
    return run


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, id_col: str = "vec_id",
           vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES,
           min_points: int = MIN_POINTS, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``queries`` (a condition on ``vec_id``) is true.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (inner
    product of the original vectors), largest first, ties to the smaller id; a
    row is not its own neighbour. Rows with a null id, and vectors that are null, zero
    or hold a null or non-finite component, take no part. A query's candidates
    are the vectors with as many components as it has: each length is searched
    on its own. Rows that repeat an id and a vector count
    once; rows with one id and different vectors are different candidates, and
    different queries. Fewer than two vectors, or no query, give an empty
    result. Other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("embedding"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))))
    # Places for the query's own vectors among those found: one each.
    own = (rows.where(queries).distinct().groupBy(F.size("embedding").alias("n"), "vec_id").count()
           .groupBy("n").agg(F.max("count").alias("own")).orderBy("n").collect())
    out = None
    for r in own:
        part = _search_length(rows.where(F.size("embedding") == r["n"]), queries, r["n"], k, k + r["own"],
                              tables, probes, min_points, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return out


def _search_length(rows: DataFrame, queries: Column, size: int, k: int, keep: int, tables: int, probes: int,
                   min_points: int, block: int) -> DataFrame:
    """``search`` among usable vectors of ``size`` components."""
    spark = rows.sparkSession
    # Of equal vectors no more than the first ``keep`` ids can be among a query's nearest.
    place = F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))
    entries = (rows.withColumn("place", place).where(F.col("place") <= keep)
               .groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    entries = written(entries.select(F.monotonically_increasing_id().alias("entry"), "ids", "embedding"), "ann-entries")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    low, high = entries.agg(F.min(norm), F.max(norm)).first()
    hashing = CrossPolytope(size, high if high and high > low * 1.001 else 0.0, tables)
    signed = 2 * hashing.axes

    index = written(entries.select("ids", "embedding").mapInArrow(
        _index(hashing, size), "g int, second int, ids array<bigint>, embedding array<double>"), "ann-index")
    # No more counts than buckets that hold a vector.
    held = index.groupBy("g", "second").count().toArrow()
    first, second, number = (held[c].to_numpy().astype(np.int64) for c in ("g", "second", "count"))
    blocks = -(-np.bincount(first, number, tables * signed).astype(np.int64) // block)
    counts = spark.sparkContext.broadcast((first * signed + second, number))

    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = written(asked.join(entries, "embedding").select("query_id", F.col("entry").alias("q"), "embedding"), "ann-queries")
    # Few bytes and much work: dealt out by number, which is not coalesced, and by another key than the
    # duplicates are, or Spark takes the second exchange for a repeat of the first.
    dealt = asked.select("q", "embedding").dropDuplicates(["q"]).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("q"))
    probing = dealt.mapInArrow(_probe(hashing, size, counts, probes, min_points),
                               "g int, q bigint, probes array<int>, embedding array<double>")
    # A query goes to all blocks of a first axis, a vector to one.
    hot = [F.lit(int(x)) for g in np.flatnonzero(blocks > 1) for x in (g, blocks[g])]
    number = F.coalesce(F.try_element_at(F.create_map(*hot), F.col("g")), F.lit(1)) if hot else F.lit(1)
    points = index.withColumn("block", F.pmod(F.xxhash64("ids"), number).cast("int"))
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), number - 1)))
    found = (points.groupBy("g", "block").cogroup(probing.groupBy("g", "block"))
             .applyInArrow(_search(size, signed, keep), "q bigint, t int, scores array<double>, found array<bigint>"))
    merged = written(found.groupBy("q").applyInArrow(_merge(keep), "q bigint, scores array<double>, found array<bigint>"),
                     "ann-found")
    others = F.filter(F.arrays_zip("scores", "found"), lambda x: x["found"] != F.col("query_id"))
    return (asked.select("query_id", "q").join(merged, "q")
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.found").alias("vec_id"),
                    F.col("x.scores").alias("score")))
