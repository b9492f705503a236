"""Cleaning of a corpus: quality rules, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns what its successor reads; between stages run() writes Parquet to
the shared folder, and deletes what the stages before have written there. All stages but the last return the columns of
documents. Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns of any name are
handled as the operators' docstrings say; what that means for a stage stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import op4_minhash, op5_langid, op7_repeats, op9_quality, op10_packing
from foliospark.llm.common import materialize, scratch, small_batches, table
from foliospark.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules; null and empty texts fail, repeated rows are judged each."""
    return op9_quality.accepted(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language, and puts the language that it finds into lang.

    It learns from the labelled documents of its input; without any, all documents go.
    """
    small_batches(spark)
    return op5_langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each class of near-duplicates; rows with a null id all stay."""
    small_batches(spark)
    return op4_minhash.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier; documents that lose all their text go, those with a null id lose nothing."""
    small_batches(spark)
    return op7_repeats.without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences; a null or empty text is its end token."""
    small_batches(spark)
    pieces = op10_packing.pack(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", repeat_dedup), ("packing", packing)]

#: Hashing, hyperdimensional vectors and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            last = written.pop()
            written += before
        before = [last]
    return STAGES[-1][1](spark, docs, sf_dir)
