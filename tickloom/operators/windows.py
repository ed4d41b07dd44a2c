"""Walk-forward windows, segments between gaps, sequences, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import bounded, running


def spans(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """``first`` and ``last`` day of each series; rows without a time have no part."""
    day = F.to_date(at)
    return df.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"))


def month_windows(spans: DataFrame, train: int, test: int) -> DataFrame:
    """For each row of ``spans`` its train and test ranges, which move on by the test length in months; start days are at most 28."""
    begin = F.make_date(F.year("first"), F.month("first"), F.least(F.dayofmonth("first"), F.lit(28)))
    months = (F.greatest(F.ceil(F.months_between("last", "first")), F.lit(0)) + 1).cast("int")
    steps = spans.withColumn("_begin", begin).withColumn("_k", F.explode(F.sequence(F.lit(0), months, F.lit(test))))
    ranges = {n: F.add_months("_begin", F.col("_k") + m) for n, m in (("train_start", 0), ("test_start", train), ("test_end", train + test))}
    dated = steps.withColumns({"window": (F.col("_k") / test).cast("long"), **ranges})
    return dated.where(F.col("test_end") <= F.col("last")).drop("_begin", "_k", "first", "last")


def day_windows(spans: DataFrame, train: int, test: int, step: int, to_monday: bool = False, validation: int = 0) -> DataFrame:
    """For each row of ``spans`` train and test ranges in days, and ``validation_end`` where a validation range follows the test.

    ``to_monday`` moves the first start to the Monday on or after it. Windows whose last range ends after the span are left out.
    """
    snapped = F.when(F.weekday("first") > 0, F.date_add("first", 7 - F.weekday("first"))).otherwise(F.col("first")) if to_monday else F.col("first")
    starts = F.sequence(F.col("_from"), F.greatest("last", "_from"), F.expr(f"INTERVAL {step} DAYS"))
    days = spans.withColumn("_from", snapped).select(*spans.columns, F.posexplode(starts).alias("_window", "train_start"))
    ranges = {"test_start": train, "test_end": train + test} | ({"validation_end": train + test + validation} if validation else {})
    dated = days.withColumns({"window": F.col("_window").cast("long"), **{n: F.date_add("train_start", k) for n, k in ranges.items()}})
    return dated.where(F.col(list(ranges)[-1]) <= F.col("last")).drop("_window", "first", "last")


def month_ranges(spans: DataFrame) -> DataFrame:
    """For each row of ``spans`` the calendar months that it touches, clipped to it."""
    months = spans.withColumn("_month", F.explode(F.sequence(F.trunc("first", "month"), F.col("last"), F.expr("INTERVAL 1 MONTH"))))
    clipped = months.withColumns({"range_start": F.greatest("_month", "first"), "range_end": F.least(F.add_months("_month", 1), "last")})
    return clipped.where("range_start < range_end").drop("_month", "first", "last")


def segments(bars: DataFrame, gap_s: int) -> DataFrame:
    """``segment`` and ``pos``: a new segment starts where more than ``gap_s`` seconds have passed since the row before."""
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    marked = bounded(bars, lambda w: {"_new": F.coalesce((micros - F.lag(micros).over(w) > gap_s * 1_000_000), F.lit(True)).cast("long")}, back=1)
    counted = running(marked, {"segment": ("sum", F.col("_new")), "_first": ("last", F.when(F.col("_new") == 1, F.col("idx")))})
    return counted.withColumns({"segment": F.col("segment") - 1, "pos": F.col("idx") - F.col("_first")}).drop("_new", "_first")


def sequences(segmented: DataFrame, length: int, stride: int) -> DataFrame:
    """Starts of all whole sequences: every ``stride`` rows of a segment that leave ``length`` rows."""
    sizes = segmented.groupBy("instrument", "segment").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    enough = sizes.where(F.col("n") >= length)
    offsets = enough.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - length, F.lit(stride).cast("long"))))
    return offsets.select("instrument", "segment", "offset", (F.col("first_idx") + F.col("offset")).alias("start_idx"))


def draw_starts(segmented: DataFrame, length: int, n: int, seed: int = 0) -> DataFrame:
    """``n`` starts of whole sequences, each as likely as any other; with replacement where there are fewer than ``n``.

    Starts are ordered by a hash of their place and the seed, so a seed gives the same draw on any cluster; each task
    keeps its first ``n`` only. Without any start an error is raised.
    """
    starts = sequences(segmented, length, 1)
    sizes = segmented.groupBy("instrument", "segment").agg(F.count("*").alias("n")).where(F.col("n") >= length)
    total = sizes.agg(F.sum(F.col("n") - length + 1)).first()[0] or 0
    if total == 0:
        raise ValueError(f"no segment has {length} rows")
    if total >= n:
        return starts.orderBy(F.md5(F.concat_ws(":", "instrument", "start_idx", F.lit(seed))), "instrument", "start_idx").limit(n)
    numbered = starts.withColumn("_at", F.row_number().over(Window.orderBy("instrument", "start_idx")) - 1)
    draw = F.conv(F.left(F.md5(F.concat_ws(":", "id", F.lit(seed))), F.lit(15)), 16, 10).cast("long")
    return numbered.join(segmented.sparkSession.range(n).select((draw % total).alias("_at")), "_at").drop("_at")


def chrono_split(df: DataFrame, share: float, purge: int = 0) -> DataFrame:
    """``part``: train, purge or validation by position in the series; the tail is validation."""
    counts = df.groupBy("instrument").agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_n") * share)
    part = F.when(F.col("idx") < cut - purge, "train").when(F.col("idx") < cut, "purge").otherwise("validation")
    return df.join(counts, "instrument").withColumn("part", part).drop("_n")
