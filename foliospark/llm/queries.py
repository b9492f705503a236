"""Queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_vafile, op2_tokens, op3_licenses, op4_minhash, op5_langid, op6_html, op7_repeats, op8_wordbpe, op9_quality, op10_packing
from .common import table

# The pattern that splits text before the merges of the rank files, and their free id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; the driver reads it and broadcasts what the tasks need."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vafile_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), PATTERN, END_OF_TEXT)


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses.scan(table(spark, sf_dir, "documents"))


def op4_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_minhash.classes(table(spark, sf_dir, "documents"))


def op5_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_langid.identify(table(spark, sf_dir, "documents"))


def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_repeats.digests(op7_repeats.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = op8_wordbpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.quality(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("char_js", "word_js")})


def op10_packing_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op10_packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vafile_top_k, op2_separator_token_counts, op3_license_rules, op4_probminhash_near_dedup, op5_hyperdimensional_langid, op6_crf_main_text, op7_run_length_repeats, op8_bpe_encode_decode, op9_quality_rules, op10_packing_cost)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_rules": op3_licenses.oracle(), "op9_quality_rules": op9_quality.oracle()}
