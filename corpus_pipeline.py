"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

STAGES are (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.classifier import keep_good
from skein.llm.common import discard, read, scratch
from skein.llm.packing import pack, word_lengths
from skein.llm.simhash import drop_near_duplicates
from skein.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weakly supervised scorer rejects; a text without words, null or empty, is rejected."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that with the smallest doc_id. Rows with a null doc_id stay."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of all documents but the first that has them; what is left blank by that goes. Null and
    empty texts and rows with a null doc_id stay as they are."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its bucket, batch and slot; a null text has no words, null and repeated doc_ids get slots too."""
    return pack(word_lengths(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: SQL can't express the classifier's EM, XXH64 or MinHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files go as soon as the next one's are written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        docs = before = kept
    return docs
