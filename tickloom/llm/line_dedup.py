"""Removal of lines that spread over many sites.

A line's spread is the number of distinct sites (``source``) it occurs on. One aggregation by line
hash merges HyperLogLog sketches of the sites; lines whose estimate lies near the threshold are
counted exactly; the others are decided by the estimate. Of a spread line, the first occurrence
(smallest document id, then position) stays and all others go, so that no text is lost altogether.
DataFrame functions only.

Lines and rows are told apart by 128-bit hashes. The candidates and the spread lines are written once; where
they are few (``FEW_LINES``, counted) they are sent to all tasks and no line moves, otherwise lines are joined
by hash and those of a frequent line are dealt over as many salts as its count asks for.

Defined cases: a null text stays null; a null source is no site; lines of ASCII white space alone (spaces, tabs,
returns and the like) are never removed; repeated rows count as occurrences of the same place; of several first places (ties) the
smallest id and position stays, null document ids sort first; very long texts and lines are read whole;
other columns pass through, and where the table has a column ``n_lines`` or ``n_removed`` of its own, it stays
and the added one is called ``line_dedup_n_lines`` or ``line_dedup_n_removed``; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, split_join

MIN_SITES = 10
MARGIN = 0.15
SKETCH_BITS = 10
#: At most this many lines, of 64 bytes each, are broadcast.
FEW_LINES = 200_000
#: Working columns, named so that a table's own columns do not clash with them.
OWN_KEY, OWN_GONE = "__line_row_key", "__line_gone"
VISIBLE = r"[^\x20\x09-\x0D]"


def _hash128(*columns: Column | str) -> Column:
    """Two 64-bit hashes of other seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))


def _row_key(site: str) -> Column:
    return _hash128("doc_id", site, "text")


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row for each visible line: row key, site, place and hash."""
    numbered = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", _row_key(site).alias("row_key"), F.col(site).alias("site"), numbered)
    return lines.where(F.col("line").rlike(VISIBLE)).select("doc_id", "row_key", "site", "pos", _hash128("line").alias("line_hash"))


def _of_lines(lines: DataFrame, some: DataFrame) -> DataFrame:
    """The lines with a hash in ``some`` (line_hash, n and more; on disk), ``n`` being their count."""
    if some.count() <= FEW_LINES:
        return lines.join(F.broadcast(some.drop("n")), "line_hash")
    return split_join(lines, some.drop("n"), "line_hash", F.struct("row_key", "pos"), counts=some.select("line_hash", "n"))


def spread_lines(docs: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """line_hash, its count n, and the place (first_doc, first_pos) that stays, of every line on ``min_sites`` sites or more."""
    lines = _lines(docs, site)
    merged = lines.groupBy("line_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"),
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    merged = materialise(merged.where(F.col("n") >= min_sites).where(F.col("sites") >= min_sites * (1 - margin)), "candidates")
    near = merged.where(F.col("sites") <= min_sites * (1 + margin)).select("line_hash", "n")
    pairs = _of_lines(lines, near).select("line_hash", "site").distinct()
    exact = pairs.groupBy("line_hash").agg(F.count("site").alias("exact"))
    decided = merged.join(exact, "line_hash", "left").where(F.coalesce("exact", "sites") >= min_sites)
    return materialise(decided.select("line_hash", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")), "spread")


def dedup_lines(docs: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """The documents without their spread lines, with ``n_lines`` and ``n_removed`` added."""
    spread = spread_lines(docs, site=site, min_sites=min_sites, margin=margin)
    gone = _of_lines(_lines(docs, site), spread).where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
    per_row = gone.groupBy(F.col("row_key").alias(OWN_KEY)).agg(F.collect_set("pos").alias(OWN_GONE))
    lines, dropped = F.split("text", "\n", -1), F.col(OWN_GONE)
    count = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), count - 1), dropped)
    text = F.when(dropped.isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    joined = docs.withColumn(OWN_KEY, _row_key(site)).join(per_row, OWN_KEY, "left")
    added = {c: f"line_dedup_{c}" if c in docs.columns else c for c in ("n_lines", "n_removed")}
    return joined.select(
        *[F.col(c) if c != "text" else text.alias("text") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias(added["n_lines"]),
        F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long").alias(added["n_removed"]),
    )
