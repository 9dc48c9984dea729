"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crossbasket.llm import byte_bpe, decontaminate, languages, near_duplicates, personal, phrases, quality, runs, secrets, shards, token_counts, toxicity, urls
from crossbasket.llm.shared import table


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.report(found)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, folder, "documents"), model)


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.report(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"))


def op6_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.report(table(spark, folder, "documents"))


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal.report(table(spark, folder, "documents"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.byte_bpe(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages")).drop("n_hits")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_token_counts": op2_token_counts,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_shards": op4_shards,
        "op5_quality": op5_quality,
        "op6_languages": op6_languages,
        "op7_personal": op7_personal,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_secrets": op10_secrets,
        "op11_collocations": op11_collocations,
        "op12_url_filter": op12_url_filter,
        "op13_periodic_runs": op13_periodic_runs,
    }
