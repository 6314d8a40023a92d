"""A corpus pipeline: language, repeated lines, near duplicates, benchmark passages, token ids.

Each stage calls one operator on all documents that the stage before it kept; run() writes every
stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, decontam, langid, linedup, simhash
from hourloom.llm.base import documents, fold_of, stored
from hourloom.llm.queries import BYTE_RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised; texts that are null or have no letter go."""
    stats = langid.train(docs, F.coalesce(fold_of("doc_id", 5) != 0, F.lit(True)))
    kept = langid.predict(docs, stats, carry=("text", "lang", "source", "n_chars"))
    return kept.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in the last; ``n_chars`` follows the text."""
    kept = linedup.dedupe_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group of near duplicates one row: the smallest id, null ids last, then a hash of the row."""
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", "lang", "source", "n_chars"))
    return found.filter(F.col("n_hit") == 0).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, checked by decoding them.

    The ids are written before they are decoded, so that a task has one Python worker at a time.
    """
    path = public_tokenizers.path(BYTE_RANKS)
    encoded = stored(bpe.encode(docs, path, public_tokenizers.PATTERN, carry=("text", "lang", "source")), "stage-ids")
    back = bpe.decode(encoded, path)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("tokens", token_ids),
]

# Language statistics, SimHash links and byte pairs are not stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
