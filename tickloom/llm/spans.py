"""Places of regular-expression matches as column expressions.

Spark has no function that returns the positions of all matches. Here each match is wrapped in two
control characters, the text is split at the first of them, and the lengths of the parts are summed.
Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\x01", "\x02"
SPAN = "struct<start:int,end:int,text:string>"


def unmarked(text: Column) -> Column:
    """The text with the two control characters replaced by a third one: lengths and other characters stay."""
    return F.translate(text, OPEN + CLOSE, "\x03\x03")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern in ``unmarked`` text: array of start, end, text."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        close = F.instr(part, CLOSE)
        end = (acc["at"] + close - 1).cast("int")
        span = F.struct(acc["at"].alias("start"), end.alias("end"), F.substring(part, F.lit(1), close - 1).alias("text"))
        return F.struct(
            (acc["at"] + F.length(part) - (close > 0).cast("int")).cast("int").alias("at"),
            F.when(close > 0, F.concat(acc["spans"], F.array(span.cast(SPAN)))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def ranked(spans: Column, rank: int, kind: str) -> Column:
    def one(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"))

    return F.transform(spans, one)


def ordered(kinds: dict[str, Column]) -> Column:
    """All spans of several kinds by start, then by the order of the kinds: array of start, rank, end, kind, text."""
    return F.array_sort(F.concat(*[ranked(spans, rank, kind) for rank, (kind, spans) in enumerate(kinds.items())]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each ordered span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
