"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.session import scratch_path
from cellpulse.sources.tables import read_table

#: Words are maximal runs of anything but these bytes (space, tab to carriage return).
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors.

    Unlike a checkpoint it is small on disk and forgets how its rows are
    dealt out, so a later join by a hot key can be split.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column has it (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: no words)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.filter(parts, lambda w: w != F.lit(""))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column, null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to ``most`` at a time (one row at least).

    Keeps the working memory of a vectorised step bounded whatever the size
    of the Arrow batch; a single longer row still comes whole.
    """
    start, total = 0, 0
    for row, n in enumerate(lengths):
        if row > start and total + n > most:
            yield start, row
            start, total = row, 0
        total += int(n)
    if len(lengths) > start:
        yield start, len(lengths)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column without null items."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


class Numbering(dict):
    """Numbers its keys from 0 in the order in which they are first looked up."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of the session (once per application).

    The Python functions of the operators are found there by import; a
    cluster has the package only if somebody installed it on every machine.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="cellpulse-"), "cellpulse-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "cellpulse").rglob("*.py")):
            z.write(path, path.relative_to(root))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
