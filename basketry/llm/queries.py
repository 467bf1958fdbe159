"""Registered queries of this folder: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (byte_bpe, jaccard_join, jump_shards, mil_toxicity, ordinal_quality, phrase_index, rotated_codes,
                          spaced_seeds, suffix_dedup, super_minhash, token_records, turn_repair, warc_bundles)

SHARDS = 24
QUERY_STEP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    return token_records.token_records(table(spark, sf_dir, "documents"), vocabulary, end_id=0)


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % QUERY_STEP == 0, k=20)


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil_toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return mil_toxicity.score(docs, model).select(
        "doc_id", mil_toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst", "worst_score")


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.warc_bundles(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=True, words=51)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return ordinal_quality.rate(docs, model).withColumn("selected", F.col("tail_probability") >= 0.5)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.collocations(table(spark, sf_dir, "documents"), least=100, most=5, top=2000)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations"))).report()


def op13_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_groups(table(spark, sf_dir, "documents"), percent=80, n=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_records, op2_jump_shards, op3_rotated_codes, op4_spaced_seeds, op5_mil_toxicity,
                            op6_warc_bundles, op7_suffix_dedup, op8_byte_bpe, op9_ordinal_quality, op10_jaccard_join, op11_phrase_index, op12_turn_repair, op13_super_minhash)}

# Nearest neighbours are compared by recall, the others need hashing, codecs or learning; see tests/llm.
ORACLE_SQL: dict[str, str] = {}
