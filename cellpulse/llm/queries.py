"""Queries ``opN_<name>``: each operator over its whole table, and their SQL.

The operators keep their own interfaces and outputs; a query only picks the
production parameters and the columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.llm import (ann, bpe, ctw, decontaminate, pii, quality, resample, secret_scan, simhash, sql, substring_dedup,
                           url_filter, whiten, word_bpe)
from cellpulse.llm.common import documents, ship_package
from cellpulse.sources.tables import read_table

#: Vocabulary of the encoding query.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Vocabulary of the word encoding query.
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("h")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir), with_text=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).drop("h")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY), with_ids=False)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


REGISTRY = {q.__name__: _shipped(q) for q in (
    op1_quality_classifier, op2_nearest_neighbours, op3_simhash, op4_url_filter, op5_bpe, op6_lm_score,
    op7_substring_dedup, op8_secret_scan, op9_decontaminate, op10_pii, op11_resample, op12_whitening, op13_word_bpe)}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = sql.ORACLE
