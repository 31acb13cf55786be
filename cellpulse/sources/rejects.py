"""Text tables with bad tokens: good rows go on, bad ones are kept with their place.

A token that is not of its field's type does not end the job; its row leaves
the table and is listed as (file, line, field, token), one row per bad token.
A share of bad rows above a threshold does end the job: then the file is not
what it was thought to be.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .csv import fields


class Checked(NamedTuple):
    """Typed good rows; rejects (file, line, field, token); how many rows were read and how many left out."""
    rows: DataFrame
    rejects: DataFrame
    n_read: int
    n_rejected: int


class TooManyRejects(ValueError):
    pass


def read_checked(spark: SparkSession, path, schema: str, most: float = 0.01, header: bool = False,
                 strict: Sequence[str] | None = None, **options) -> Checked:
    """CSV rows whose ``strict`` fields (default: all that are not text) are of their types.

    An empty field is null, which is of any type. ``line`` counts a file's
    lines from 1, the header line included and blank lines left out, as the
    reader does; it is exact for files that Spark splits, too. More than
    ``most`` of the rows rejected raises ``TooManyRejects`` with an example.

    One pass finds the rejects and counts the lines of each file split, one
    row per split; the good rows are read when they are used.
    """
    pairs = fields(schema)
    reader = spark.read.schema(", ".join(f"`{n}` string" for n, _ in pairs)).option("mode", "PERMISSIVE").option("header", header)
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.csv(path)
    checked = [(n, t) for n, t in pairs if t != "string" and (strict is None or n in strict)]

    def bad(name: str, kind: str):
        return F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()

    tokens = F.filter(F.array(*[F.when(bad(n, t), F.struct(F.lit(n).alias("field"), F.col(n).alias("token"))) for n, t in checked]),
                      lambda x: x.isNotNull()) if checked else F.array()
    # Within a split the numbers follow the lines; a task reads its splits one after the other.
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.monotonically_increasing_id().alias("at"), tokens.alias("bad"))
    per_split = placed.groupBy("file", "split").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum((F.size("bad") > 0).cast("long")).alias("n_bad"))
    per_split = materialize(per_split)
    total = per_split.agg(F.sum("n"), F.sum("n_bad")).first()
    n_read, n_bad = total[0] or 0, total[1] or 0
    # A window over the splits of one file.
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_split.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rejects = (placed.where(F.size("bad") > 0).join(starts, ["file", "split"])
               .select("file", (F.col("before") + F.col("at") - F.col("first") + (2 if header else 1)).alias("line"),
                       F.explode("bad").alias("b"))
               .select("file", "line", "b.field", "b.token"))
    if n_bad > most * n_read:
        example = rejects.first()
        raise TooManyRejects(f"{n_bad} of {n_read} rows rejected, e.g. {example.token!r} for {example.field} "
                             f"in line {example.line} of {example.file}")
    good = raw
    for n, t in checked:
        good = good.where(~bad(n, t))
    kinds = dict(pairs)
    good = good.select(*[F.col(c).try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(c) for c in good.columns])
    return Checked(good, rejects, n_read, n_bad)
