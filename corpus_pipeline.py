"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbasket.llm import byte_bpe, decontaminate, near_duplicates, personal, quality
from crossbasket.llm.shared import table, written

# SQL cannot state the language model, the network or the tokens.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep.

    A null or empty text fails the rules. Rows are judged one by one, so repeated rows share their fate;
    an empty table stays empty, and columns go through whatever their names.
    """
    return quality.kept_rows(docs)


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids`` (left_semi) or is not (left_anti); no column name can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    ids = ids.select(F.col("doc_id").alias("id"))
    return rows.join(ids, F.col("row.doc_id").eqNullSafe(F.col("id")), how).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the smallest id.

    Of rows that repeat a kept id and its text one stays; rows that share an id but no text all stay. Null and
    empty texts are linked with nothing and stay; an empty table stays empty.
    """
    kept = near_duplicates.near_duplicates(docs).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = written(kept, "kept")
    repeated = _with_ids(docs, kept.filter("n > 1"), "left_semi").dropDuplicates(["doc_id", "text"])
    return _with_ids(docs, kept.filter("n = 1"), "left_semi").unionByName(repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a window of a benchmark item, with all rows of their ids.

    Null and empty texts hold none and stay; an empty table stays empty.
    """
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return _with_ids(docs, written(found.filter("n_hit > 0").select("doc_id").distinct(), "hit"), "left_anti")


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; every row stays.

    A null text stays null, an empty one empty; repeated rows are treated alike, an empty table stays empty.
    """
    return personal.redacted(docs, personal.fit(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, as digests and numbers, with digests of the decoded bytes; a row for each row.

    A null text has no tokens, as an empty one; other columns are left out, an empty table gives no rows.
    """
    return byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_stage),
    ("byte-level BPE", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
