"""Folders of results: whole or not there, listed and removed through Spark's own file system.

A path may be on any store that Spark reads, so nothing here uses the local
file system.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import SCRATCH_PATHS, checkpoint_root, scratch_path

#: The mark that Spark's writers leave when all of a table is there.
DONE = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def is_whole(spark: SparkSession, path: str) -> bool:
    """True if a table was written to ``path`` to its end."""
    fs, there = _at(spark, f"{path}/{DONE}")
    return fs.exists(there)


def children(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the folders in ``path``; none if it is not there."""
    fs, there = _at(spark, path)
    if not fs.exists(there):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(there) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    fs, there = _at(spark, path)
    fs.delete(there, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder within its store, in one step."""
    fs, source = _at(spark, path)
    _, target = _at(spark, to)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"could not move {path} to {to}")


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """A small record as a folder of text, whole or not there."""
    spark.createDataFrame([(json.dumps(note, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


class Published:
    """A table whose new state takes the place of the old one whole, or not at all.

    Each state is a folder of its own, ``v=<n>``; readers take the last whole
    one. A job that fails midway leaves a folder without its mark, which no
    reader sees; the next state gets a number of its own. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        return sorted(int(c[2:]) for c in children(self.spark, self.root) if c.startswith("v=") and c[2:].isdigit())

    def versions(self) -> list[int]:
        """Numbers of the whole states, rising."""
        return [n for n in self._numbers() if is_whole(self.spark, self.path(n))]

    def path(self, version: int) -> str:
        return f"{self.root}/v={version}"

    def publish(self, write: Callable[[str], None], check: Callable[[str], None] | None = None, keep: int | None = None) -> int:
        """Have ``write`` write a table beside the old state, check it, and make it the current one.

        ``check(path)`` raises to refuse what was written; the old state then
        stays current. ``keep`` removes all but the last so many states.
        """
        fresh = scratch_path(self.spark, "unpublished")
        write(fresh)
        if not is_whole(self.spark, fresh):
            raise OSError(f"{fresh} was not written to its end")
        if check is not None:
            check(fresh)
        number = max(self._numbers(), default=0) + 1
        move(self.spark, fresh, self.path(number))
        if keep is not None:
            for old in self.versions()[:-keep]:
                remove(self.spark, self.path(old))
        return number

    def read(self, version: int | None = None) -> DataFrame:
        """A state (default: the current one) that was written as Parquet."""
        number = (self.versions() or [None])[-1] if version is None else version
        if number is None or not is_whole(self.spark, self.path(number)):
            raise FileNotFoundError(f"nothing whole in {self.root}")
        return self.spark.read.parquet(self.path(number))


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current state of ``path``, or ``path`` itself if it has no states."""
    states = Published(spark, path)
    found = states.versions()
    return states.path(found[-1]) if found else path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the scratch tables and checkpoints that came up inside it.

    For jobs, one at a time in a process: what they write as results is
    elsewhere. Paths given out before the scope stay. Frames that read the
    removed tables must not be used after the scope.
    """
    checkpoint_root(spark)
    given, kept = len(SCRATCH_PATHS), set(_checkpoints(spark))
    try:
        yield
    finally:
        for path in SCRATCH_PATHS[given:]:
            remove(spark, path)
        del SCRATCH_PATHS[given:]
        for name in set(_checkpoints(spark)) - kept:
            remove(spark, f"{spark.sparkContext.getCheckpointDir()}/{name}")


def _checkpoints(spark: SparkSession) -> list[str]:
    """Folders of this application's checkpoints."""
    return [c for c in children(spark, spark.sparkContext.getCheckpointDir()) if c.startswith("rdd-")]
