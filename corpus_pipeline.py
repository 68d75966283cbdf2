"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage works on all rows that its predecessor kept. The stages before the
last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.common import table
from telemill.llm.decontaminate import contained_items
from telemill.llm.line_dedup import remove_repeats
from telemill.llm.minhash import near_duplicates
from telemill.llm.packing import pack_documents
from telemill.llm.toxicity import score_documents
from telemill.session import fresh_path, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts scored below ``REJECT``; all labelled rows are learned from, a quarter of them for calibration."""
    third = F.crc32(F.col("doc_id").cast("string")) % 4 == 3
    scored = score_documents(docs, table(spark, sf_dir, "labels"), F.lit(True), third, carry=True)
    return scored.where(F.col("score") < REJECT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated chunks; a text of which nothing is left and that stands in one earlier text is a copy and goes."""
    done = remove_repeats(docs, copy_col="copy").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where(~F.col("copy")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates."""
    drop = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a benchmark item."""
    drop = contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing),
]
ORACLE_SQL = None  # a fitted model and a tokenizer; tests/llm check the stages one by one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
