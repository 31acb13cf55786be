"""Text sources and sinks of the three analyses.

The original split every line by hand (``String.split``, a character loop
for ragged rows) and dropped headers by content. Here Spark's CSV reader
does the parsing with an explicit schema: quoted fields with commas, a
header per file and short rows (padded with nulls) are handled by the reader,
in parallel, per file split. Fields are read as text and cast strictly: a
value that is not of its type fails the job and names itself, as the
original's number parsing did, instead of becoming null or zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEVICE_COLUMNS, PROFILE_COLUMNS
from ..functions.text import strict_cast, to_line

# Record schemas used by our own writers (names follow the fixtures).
DEVICE_LOG_SCHEMA = ", ".join(f"{name} {dtype}" for name, dtype in DEVICE_COLUMNS)
LOCATED_SCHEMA = ("user_id bigint, dt date, hr int, x double, y double, "
                  "areaid int, clusterid int")
CENTRE_SCHEMA = "cx double, cy double"
HOURS = 24


def wide_schema(keys: Sequence[tuple[str, str]] = (("user_id", "bigint"), ("dt", "date")),
                hours: int = HOURS) -> str:
    cols = [f"{k} {t}" for k, t in keys]
    for h in range(hours):
        cols += [f"x{h} double", f"y{h} double"]
    return ", ".join(cols)


def tag_schema(key: str = "user_id", key_type: str = "bigint", value_type: str = "int",
               cols: Sequence[str] = PROFILE_COLUMNS) -> str:
    return ", ".join([f"{key} {key_type}"] + [f"{c} {value_type}" for c in cols])


# --- device logs ---------------------------------------------------------------

def fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL schema."""
    return [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]


def read_text_table(spark: SparkSession, path, schema: str, strict: Sequence[str] | None = None, **options) -> DataFrame:
    """CSV with every field read as text, then cast to ``schema`` strictly.

    ``strict`` limits the check to some columns (default: all that are not
    text). A partition folder's column may stand among the fields.
    """
    pairs = fields(schema)
    reader = spark.read.schema(", ".join(f"`{n}` string" for n, _ in pairs)).option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    return typed(reader.csv(path), schema, strict)


def typed(df: DataFrame, schema: str, strict: Sequence[str] | None = None) -> DataFrame:
    """Strict casts of text columns to the types of ``schema``; other columns stay."""
    types = dict(fields(schema))
    checked = set(types if strict is None else strict)
    return df.select(*[
        F.col(c) if types.get(c, "string") == "string"
        else (strict_cast(c, types[c], c) if c in checked else F.col(c).try_cast(types[c])).alias(c)
        for c in df.columns])


def read_device_logs(spark: SparkSession, path: str, schema: str = DEVICE_LOG_SCHEMA,
                     header: bool = True, encoding: str = "UTF-8",
                     header_text: str | None = None, header_col: str | None = None) -> DataFrame:
    """Quoted CSV device logs, one directory (all periods) in one read.

    A header line per file is skipped with ``header=True``. Files whose
    header is not on line one can instead be cleaned by content: rows whose
    ``header_col`` contains ``header_text`` are dropped before any cast.
    Partition folders (``period=N``) become the typed partition column given
    in ``schema``. Encodings outside Spark's standard set (e.g. GBK for
    Chinese vendor names) need ``spark.sql.legacy.javaCharsets=true`` in the
    session.
    """
    # The folder's column keeps its type, so a filter on it prunes folders.
    raw = ", ".join(f"{n} {t if n == 'period' else 'string'}" for n, t in fields(schema))
    df = (spark.read.schema(raw)
          .option("header", header).option("quote", '"').option("escape", '"')
          .option("encoding", encoding).option("mode", "PERMISSIVE")
          .csv(path))
    if header_text is not None and header_col is not None:
        df = df.where(~F.coalesce(F.col(header_col).contains(header_text), F.lit(False)))
    typed_fields = ", ".join(f"{n} {t}" for n, t in fields(schema) if n != "period")
    return typed(df, typed_fields)


def for_folders(df: DataFrame, col: str) -> DataFrame:
    """Cluster rows by output folder before a ``partitionBy`` write.

    The ``rebalance`` hint (AQE) sends a folder's rows to few tasks, so each
    task writes few files instead of one per folder, splits the partition of
    a hot folder and coalesces small ones.
    """
    return df.hint("rebalance", col)


def write_device_logs(df: DataFrame, path: str, partition_by: str | None = "period") -> None:
    """Quoted CSV with a header per file; one folder per period."""
    if partition_by:
        df = for_folders(df, partition_by)
    w = df.write.mode("overwrite").option("header", True).option("quoteAll", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def read_ids(spark: SparkSession, path: str, col: str = "user_id",
             dtype: str = "bigint") -> DataFrame:
    """Target list: one id per line."""
    return read_text_table(spark, path, f"{col} {dtype}")


def write_ids(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


# --- wide location rows ----------------------------------------------------------

def write_wide_locations(df: DataFrame, path: str, hours: int = HOURS) -> None:
    """Wide rows as CSV with a missing point (0) written as an empty field."""
    coords = {f"{a}{h}" for h in range(hours) for a in "xy"}
    cols = [f"nullif(`{c}`, 0D) as `{c}`" if c in coords else f"`{c}`" for c in df.columns]
    df.selectExpr(*cols).write.mode("overwrite").option("nullValue", "").csv(path)


def write_ragged_locations(df: DataFrame, path: str, keys: Sequence[str] = ("user_id", "dt"), hours: int = HOURS) -> None:
    """Wide rows as text lines that end with their last point: empty inner fields, no trailing ones."""
    coords = [f"nullif(`{a}{h}`, 0D)" for h in range(hours) for a in "xy"]
    line = to_line([*keys, *[F.expr(c) for c in coords]])
    df.select(F.regexp_replace(line, ",+$", "").alias("value")).write.mode("overwrite").text(path)


def read_wide_locations(spark: SparkSession, path: str,
                        keys: Sequence[tuple[str, str]] = (("user_id", "bigint"), ("dt", "date")),
                        hours: int = HOURS) -> DataFrame:
    """Ragged wide rows: short rows pad with nulls, empty fields are nulls; all become 0.

    A coordinate that is no number fails the job; it must not pass for a
    missing point.
    """
    df = read_text_table(spark, path, wide_schema(keys, hours))
    coords = [f"{a}{h}" for h in range(hours) for a in "xy"]
    return df.na.fill(0.0, subset=coords)


# --- usage profiles --------------------------------------------------------------

def raw_profile_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def read_profiles(spark: SparkSession, path: str, key: str = "user_id", key_type: str = "bigint",
                  width: int = 24, drop: Sequence[int] = (6, 7, 22),
                  names: Sequence[str] = PROFILE_COLUMNS, header_text: str | None = None) -> DataFrame:
    """Raw usage rows: drop the columns at positions ``drop``, strip quotes,
    blank -> 0, then key + ``names`` as doubles.

    Fields are read as text so that quotes and blanks are handled exactly as
    the raw export needs; only the kept columns are cast.
    """
    df = spark.read.schema(raw_profile_schema(width)).option("quote", "\u0000").csv(path)
    if header_text is not None:
        df = df.where(~F.coalesce(F.col("_c0").contains(header_text), F.lit(False)))
    kept = [i for i in range(width) if i not in set(drop)]
    if len(kept) != len(names) + 1:
        raise ValueError(f"{len(kept)} kept columns for a key and {len(names)} names")
    def bare(i: int):
        return F.nullif(F.translate(F.col(f"_c{i}"), '"', ""), F.lit(""))

    vals = [F.coalesce(strict_cast(bare(i), "double", n), F.lit(0.0)).alias(n) for i, n in zip(kept[1:], names)]
    return df.select(strict_cast(bare(kept[0]), key_type, key).alias(key), *vals)


def write_raw(df: DataFrame, path: str) -> None:
    """Plain CSV, nulls and empty texts as empty fields; quotes are written as they stand in the fields."""
    (df.write.mode("overwrite").option("nullValue", "").option("emptyValue", "")
       .option("quote", "\u0000").option("escapeQuotes", False).csv(path))


def write_predictions(df: DataFrame, path: str, key: str = "user_id",
                      prediction: str = "prediction") -> None:
    """Prediction sink: one text line ``key,prediction`` per scored row; a null is an empty field."""
    df.select(to_line([key, prediction]).alias("value")).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str, key: str = "user_id", key_type: str = "bigint",
                     prediction: str = "prediction") -> DataFrame:
    return read_text_table(spark, path, f"{key} {key_type}, {prediction} int")


def write_tags(df: DataFrame, path: str) -> None:
    """Tag rows as text lines key,f1,...,f20 (the tag sink)."""
    df.write.mode("overwrite").csv(path)


def read_tags(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_text_table(spark, path, schema or tag_schema())


# --- located records and centres ---------------------------------------------------

def write_located_by_area(df: DataFrame, root: str, area: str = "areaid") -> None:
    """One folder per area (``area=00``, ``area=01``...); files keep all seven fields."""
    keyed = df.withColumn("area", F.format_string("%02d", F.col(area)))
    for_folders(keyed, "area").write.mode("overwrite").partitionBy("area").csv(root)


def read_located(spark: SparkSession, root: str, schema: str = LOCATED_SCHEMA, area: int | None = None) -> DataFrame:
    """Located records of all area folders below ``root`` as one frame, or of one area's folder.

    Whatever areas have a folder are read (a filter on the folder's name
    prunes the others); a root without any is empty.
    """
    names = [n for n, _ in fields(schema)]
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in [*names, "area"])).csv(root)
    if area is not None:
        raw = raw.where(F.col("area") == f"{area:02d}")
    return typed(raw.select(*names), schema)


def write_centres(centres: DataFrame, root: str, area: str = "areaid",
                  order: str = "clusterid") -> None:
    """One ``x,y`` file per area, lines in cluster-id order (the model format)."""
    (centres.withColumn("area", F.format_string("%02d", F.col(area)))
            .repartition("area").sortWithinPartitions("area", order)
            .select("cx", "cy", "area")
            .write.mode("overwrite").partitionBy("area").csv(root))


def read_centres(spark: SparkSession, root: str) -> DataFrame:
    """Centre files of all areas below ``root`` -> (areaid, clusterid, cx, cy); clusterid = line number in the area.

    Lines are numbered in file-name order, then line order within a file
    (``monotonically_increasing_id`` grows with the read order inside a
    partition; a centre file is small enough to be a single split). The
    numbering window is partitioned by area, which holds one model's centres.
    """
    df = spark.read.schema("cx string, cy string, area string").csv(root)
    df = df.select(strict_cast("area", "int", "area").alias("areaid"),
                   F.col("_metadata.file_path").alias("_file"),
                   F.monotonically_increasing_id().alias("_pos"),
                   *[strict_cast(n, t, n).alias(n) for n, t in fields(CENTRE_SCHEMA)])
    w = Window.partitionBy("areaid").orderBy("_file", "_pos")
    return df.select("areaid", (F.row_number().over(w) - 1).cast("int").alias("clusterid"),
                     "cx", "cy")
