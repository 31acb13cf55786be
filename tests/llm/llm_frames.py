"""Frames and fixtures of this folder (imported: a second conftest would hide the first)."""

import random
import string

import pytest

from cellpulse.llm.common import ship_package

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key int, h string, fp int, n int, "
        "features int, words string, value int, pos int, label int, quality string")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def prose(rng: random.Random, words: int) -> str:
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(["the", "of", "and", "to", rng.choice(vocabulary), rng.choice(vocabulary)]) for _ in range(words))


def awkward_rows() -> list:
    """(id, text): nulls, empty, blank and very long texts, copies, ties, odd characters, repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 120)
    long = prose(rng, 20_000)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "two words"), (6, "The the THE"),
        (7, base), (8, base), (9, base + " end"), (10, base.upper()), (11, long), (12, "x" * 60_000),
        (13, "a " * 3_000), (14, "naïve ünïcode 日本語     emoji 🎉🎉 é"), (15, "\x0b\x0ctab\x1fsep\x00nul"),
        (16, " ".join(base.split()[40:100]) + " " + " ".join(base.split()[:60])), (17, base.replace("the", "that", 1)),
        (None, "null id " + base), (None, None), (18, "'s 't it's we'll  don't\r\n\r\n   x   "),
    ]
    rows += [rows[6], rows[3]]  # repeated rows
    rows += [(100 + i, prose(random.Random(i), 60)) for i in range(20)]
    return rows


def make(spark, rows, partitions: int = 3):
    """Documents with extra columns whose names clash with internal ones."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "h", 2, 3, 4, "w", 5, 6, 7, "q") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


@pytest.fixture(scope="session")
def awkward(spark):
    return make(spark, awkward_rows())


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
