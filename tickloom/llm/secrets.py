"""Secret scans over an incremental ledger of blobs.

Every distinct text is a blob named by its SHA-256, however many paths and versions hold it. A rule
has a version; the ledger is a Parquet folder of (blob, rule, version) triples that have been scanned and what
they gave. An increment compares identifiers first: it counts the blobs of the rows at hand, takes away the
triples that the ledger has, and only then fetches the texts that are left, one copy each. Its rows are
appended; then findings are joined back to all paths. Column expressions and joins only.

Defined cases: a null text is the empty blob; repeated rows each get the blob's findings; very long texts are
scanned whole; overlapping spans of different kinds are all kept, ties of start in the order of the rules;
other columns, of whatever name, are ignored; an empty table gives no rows and leaves the ledger as it is. An
increment that is run again (a lost driver) scans only what it did not append, and a triple that is there
twice counts once. A blob held by a third of all rows is one row after the counting step; the join back deals
its rows over salts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, split_join, text_or_empty
from tickloom.llm.spans import listed, matches, of_kind, redacted, unmarked

BASE = ("assign", "access", "hex")
#: An increment of at most this many blobs is sent to all tasks: 64 characters and an integer each.
FEW_BLOBS = 100_000
#: Working columns, named so that a table's own columns do not clash with them.
OWN_BLOB, OWN_SPANS = "__secret_blob", "__secret_spans"
SPANS = "array<struct<start:int,end:int,text:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern with its version; ``hint`` is text without which it cannot match, ``least`` the length group 1 needs."""

    kind: str
    version: int
    pattern: str
    hint: str = ""
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"(?i:password|passwd|secret|token|api_?key)[\"']?+ *+[:=] *+[\"']?+([A-Za-z0-9+/_.=-]++)", least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", "AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    Rule("forge", 1, r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", "eyJ"),
)


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def _scan(rule: Rule, text: Column) -> Column:
    found = matches(text, rule.pattern)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["text"], rule.pattern, 1)) >= rule.least)
    return F.when(F.contains(text, F.lit(rule.hint)), found).otherwise(F.array().cast(SPANS)) if rule.hint else found


def census(docs: DataFrame) -> DataFrame:
    """Each blob's identifier (``OWN_BLOB``) with the number of rows that hold it; texts do not move."""
    return docs.select(blob_id(text_or_empty()).alias(OWN_BLOB)).groupBy(OWN_BLOB).agg(F.count("*").alias("n"))


def _wanted(counted: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Blobs with the rules that the ledger lacks for them: bit i of ``todo`` stands for rule i."""
    every = (1 << len(rules)) - 1
    if ledger is None:
        return counted.select(OWN_BLOB, F.lit(every).alias("todo"))
    bit = F.try_element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, 1 << i)]), F.col("rule"))
    seen = ledger.groupBy(F.col("blob_id").alias(OWN_BLOB)).agg(F.bit_or(F.coalesce(bit, F.lit(0))).alias("seen"))
    todo = F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))
    return counted.join(seen, OWN_BLOB, "left").select(OWN_BLOB, todo.alias("todo")).where(F.col("todo") != 0)


def _texts(docs: DataFrame, wanted: DataFrame, selective: bool) -> DataFrame:
    """One text for each wanted blob. Where few are wanted, the others are left out before anything moves."""
    texts = docs.select(blob_id(text_or_empty()).alias(OWN_BLOB), text_or_empty().alias("text"))
    if selective:
        return texts.join(F.broadcast(wanted), OWN_BLOB).dropDuplicates([OWN_BLOB])
    return texts.dropDuplicates([OWN_BLOB]).join(wanted, OWN_BLOB)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, counted: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob_id, rule, spans): one for each triple that ``ledger`` does not hold yet.

    ``counted``: the census of ``docs``, where it is there already.
    """
    counted = census(docs) if counted is None else counted
    wanted = _wanted(counted, ledger, rules)
    selective = False
    if ledger is not None:
        wanted = materialise(wanted, "wanted")
        selective = wanted.count() <= FEW_BLOBS
    each = F.array(
        *[F.when(F.col("todo").bitwiseAND(1 << i) != 0, F.struct(F.lit(r.key).alias("rule"), _scan(r, F.col("clean")).alias("spans"))) for i, r in enumerate(rules)]
    )
    clean = _texts(docs, wanted, selective).withColumn("clean", unmarked(F.col("text")))
    rows = clean.select(F.col(OWN_BLOB).alias("blob_id"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("new"))
    return rows.select("blob_id", "new.rule", "new.spans")


LEDGER = f"blob_id string, rule string, spans {SPANS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger of a folder; None where nothing has been appended yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def scan_increment(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, counted: DataFrame | None = None) -> DataFrame:
    """Scan what the ledger at ``path`` lacks of these rows, append it, and return the ledger.

    ``docs`` may hold any versions of any paths; only ``text`` is read.
    """
    spark = docs.sparkSession
    scan_blobs(docs, read_ledger(spark, path), rules, counted).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id and its ordered spans under the given rules, for blobs that have any."""
    kinds = {r.key: (i, r.kind) for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for k, (i, _) in kinds.items() for x in (k, i)])
    kind = F.create_map(*[F.lit(x) for k, (_, name) in kinds.items() for x in (k, name)])
    hits = ledger.where(F.col("rule").isin(*kinds) & (F.size("spans") > 0)).dropDuplicates(["blob_id", "rule"])
    own = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), rank[F.col("rule")].alias("rank"), s["end"].alias("end"), kind[F.col("rule")].alias("kind"), s["text"].alias("text")
        ),
    )
    return hits.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list(own))).alias("secrets"))


def join_back(docs: DataFrame, found: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The documents with their blob (``OWN_BLOB``) and its spans (``OWN_SPANS``, empty where there are none)."""
    named = docs.withColumn(OWN_BLOB, blob_id(text_or_empty()))
    right = found.select(F.col("blob_id").alias(OWN_BLOB), F.col("secrets").alias(OWN_SPANS))
    counted = census(docs) if counted is None else counted
    joined = split_join(named, right, OWN_BLOB, F.monotonically_increasing_id(), "left", counts=counted)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string>>")
    return joined.withColumn(OWN_SPANS, F.coalesce(OWN_SPANS, empty))


def secret_digests(docs: DataFrame, ledger: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Counts per base rule, the digest of the base spans, and all spans of every document.

    Triples that ``ledger`` lacks are scanned, not appended; after ``scan_increment`` it lacks none.
    """
    counted = materialise(census(docs), "census") if counted is None else counted
    new = scan_blobs(docs, ledger, counted=counted)
    found = findings(new if ledger is None else ledger.select("blob_id", "rule", "spans").unionByName(new))
    return _digests(docs, found, counted)


def ledger_digests(docs: DataFrame, ledger: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The same from a ledger that has all triples of these rows: no text is scanned."""
    return _digests(docs, findings(ledger), counted)


def _digests(docs: DataFrame, found: DataFrame, counted: DataFrame | None) -> DataFrame:
    spans = F.col(OWN_SPANS)
    return join_back(docs.select("doc_id", "text"), found, counted).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(of_kind(spans, *BASE)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.col(OWN_BLOB).alias("blob_id"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found secret replaced by ``mark``; columns stay as they are."""
    counted = materialise(census(docs), "census")
    hit = join_back(docs, findings(scan_blobs(docs, counted=counted)), counted)
    text = F.when(F.size(OWN_SPANS) > 0, redacted(text_or_empty(), F.col(OWN_SPANS), mark)).otherwise(F.col("text"))
    return hit.withColumn("text", text).select(*docs.columns)
