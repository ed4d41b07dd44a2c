"""A training corpus from raw documents: good texts, without spread lines, near copies and secrets, packed.

Each stage is one operator over all rows that its predecessor kept. All but the last return the columns of
``documents``; each result is written as Parquet to the shared folder and read again for the next stage, and
what a stage wrote on its way is removed with the result before it. The last stage gives the pieces with
their token ids.

Defined cases are those of the operators: a null text is scored as the empty one, rows that repeat are copies,
null ids are rows of their own, other columns stay, an empty table gives no pieces; very long texts are read whole; of
near copies the smallest id stays, and of rows that tie for it one; without a document labelled good the first stage
keeps every document, and where all are labelled they are also its unlabelled texts. Where a stage changes
texts, ``n_chars`` is counted again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import line_dedup, near_dup, packing, quality, secrets
from tickloom.llm.common import batches_of_documents, discard, fold, materialise, table, temporary
from tickloom.llm.queries import KEEP_SCORE


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below the threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2, KEEP_SCORE)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but the first."""
    return _counted(line_dedup.dedup_lines(docs).select(*docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    return _counted(secrets.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids as 32-bit numbers, in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), as_arrays=False)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_spread_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: The classifier, MinHash candidates, Java-only patterns and the tokenizer have no SQL form; tests/llm compares with Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    batches_of_documents(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with temporary(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"stage{number}", keep=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
