"""One query for each corpus operator, with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, conversations, exact_dedup, language, line_dedup, lloyd, near_dup, packing, pii, quality, secrets, simhash, vectors
from tickloom.llm.common import fold, materialise, new_path, table
from tickloom.llm.oracles import ORACLES  # noqa: F401  the SQL beside the queries

KEEP_SCORE = 0.7


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def near_dup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents"))


def vectors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 2)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2)
    held_out, predicted = fold(F.col("doc_id")) == 2, (F.col("score") >= KEEP_SCORE).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger filled in two increments, the English crawl and then all documents, and joined back to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path, counted = new_path(spark, "ledger"), materialise(secrets.census(docs), "census")
    secrets.scan_increment(docs.where(F.col("lang") == "en"), path)
    ledger = secrets.scan_increment(docs, path, counted=counted)
    return secrets.ledger_digests(docs, ledger, counted)


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def centroids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup_query,
    "op2_packing": packing_query,
    "op3_bpe": bpe_query,
    "op4_near_dup": near_dup_query,
    "op5_vectors": vectors_query,
    "op6_language": language_query,
    "op7_quality": quality_query,
    "op8_pii": pii_query,
    "op9_exact_dedup": exact_dedup_query,
    "op10_secrets": secrets_query,
    "op11_conversations": conversations_query,
    "op12_simhash": simhash_query,
    "op13_centroids": centroids_query,
}
