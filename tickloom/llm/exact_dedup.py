"""Exact duplicates through content-defined chunk recipes.

Each normalised text is cut where its content says so, within a least and a largest chunk length. A
chunk's identifier is its hash, verified: distinct chunk texts are grouped by hash, and where one hash
stands for several texts each of them gets a number of its own. Documents are equal when their ordered
identifier lists are; only those lists are grouped, joined and compared, so long texts move once, as
distinct chunks. DataFrame functions only.

Defined cases: null counts as the empty text; equal texts form a group whatever their other columns;
the largest id of a group stays, nulls being smaller than any id; of rows that tie for it (repeated rows, or a
group of nulls only) all stay; very long texts are cut and compared whole; other columns are ignored; an empty
table gives no rows. Recipes are written once. A group that holds a third of all rows is partially aggregated,
and its rows are dealt over salts when they get their group back, by the digest of their text.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, split_join, text_or_empty

LEAST, LARGEST = 1024, 8192
#: A cut is made after white space that follows one of a few characters and precedes one of a few others.
CUT = r"(?<=[aeiou0-9.,;:][ \n\t])(?=[a-h\p{Lo}])"
CHUNK = rf"(?s).{{{LEAST},{LARGEST}}}?(?:{CUT}|\z)|(?s).{{1,{LARGEST}}}"


def normalised(text: Column) -> Column:
    """Lower case for A to Z alone."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def _shared_hashes(distinct: DataFrame) -> DataFrame:
    """The hashes that stand for several chunk texts; chunk texts move once, to be told apart."""
    return distinct.groupBy("hash").count().where("count > 1").select("hash")


def _numbered(distinct: DataFrame) -> DataFrame:
    """(hash, chunk, number) of the chunks whose hash stands for several texts."""
    both = distinct.join(_shared_hashes(distinct), "hash", "left_semi")
    listed = both.groupBy("hash").agg(F.array_sort(F.collect_list("chunk")).alias("texts"))
    return listed.select("hash", F.posexplode("texts").alias("number", "chunk"))


def recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256 and recipe (array of verified chunk identifiers: hash and number) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("norm"))
    rows = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = rows.select(chunk_hash(F.col("chunk")).alias("hash"), "chunk").distinct()
    base = texts.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: F.struct(chunk_hash(c).alias("hash"), F.lit(0).alias("number"))).alias("recipe"),
    )
    if _shared_hashes(distinct).isEmpty():
        return base
    parts = texts.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk")).distinct()
    placed = parts.withColumn("hash", chunk_hash(F.col("chunk"))).join(_numbered(distinct), ["hash", "chunk"])
    numbers = placed.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "number"))).alias("numbers"))
    fixed = F.transform("recipe", lambda r, i: F.struct(r["hash"].alias("hash"), F.coalesce(F.try_element_at(F.col("numbers"), i), F.lit(0)).alias("number")))
    return base.join(numbers, "text_sha256", "left").select(
        "doc_id", "text_sha256", F.when(F.col("numbers").isNull(), F.col("recipe")).otherwise(fixed).alias("recipe")
    )


def exact_groups(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = materialise(recipes(docs, chunk_hash), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    groups = groups.where("group_size > 1").drop("recipe")
    sizes = groups.select("text_sha256", F.col("group_size").alias("n"))
    joined = split_join(rows.drop("recipe"), groups, "text_sha256", F.monotonically_increasing_id(), "left", counts=sizes)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
