"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and gives the reread rows to the next stage.  All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import byte_bpe, jaccard_join, ordinal_quality, spaced_seeds, suffix_dedup
from basketry.llm.common import written
from basketry.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = 51  # words


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the better grade is at least a half."""
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return ordinal_quality.rate(docs, model, keep=COLUMNS).filter("tail_probability >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class."""
    return jaccard_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats: passages of over 50 words, and byte strings of 400 bytes or more (texts without
    white space have few words); n_chars follows the text."""
    return suffix_dedup.without_repeats(docs.select(*COLUMNS), words=PASSAGE).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item; rows without an id, or of one id, are judged by their own texts."""
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = spaced_seeds.overlaps(keyed.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to."""
    import public_tokenizers
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats),
    ("decontaminate", decontaminate), ("encode", encode)]

ORACLE_SQL = None  # learning, hashing and byte strings; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
