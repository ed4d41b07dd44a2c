"""As-of joins without look-ahead, and joins on bounded ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import KEYS


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], delay: str | None = None, block: str = "7 days"
) -> DataFrame:
    """Each left row with the values of the last right row at or before its time; ``delay`` shifts the right times later.

    Both sides are merged and sorted within blocks of time, so a series spreads over tasks; the last row
    of the blocks before is carried in through a small table of one row per block.
    """
    shifted = right.withColumn("time", F.col("time") + F.expr(f"INTERVAL '{delay}'")) if delay else right
    held = F.struct(F.col("time").alias("_right_time"), *values)
    first = shifted.select(*keys, "time", F.lit(0).alias("_side"), held.alias("_held"))
    second = left.select(*keys, "time", F.lit(1).alias("_side"), F.struct(*[c for c in left.columns]).alias("_row"))
    both = first.unionByName(second, allowMissingColumns=True).withColumn("_block", F.window("time", block)["start"])
    ends = first.withColumn("_block", F.window("time", block)["start"]).groupBy(*keys, "_block").agg(F.max_by("_held", "time").alias("_end"))
    starts = both.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    own = Window.partitionBy(*keys, "_block").orderBy("time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("_local", F.last("_held", ignorenulls=True).over(own)).where("_side = 1").join(carried, [*keys, "_block"])
    found = F.coalesce("_local", "_carry")
    return merged.select("_row.*", *[found[v].alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, low: Column, high: Column, width: int) -> DataFrame:
    """Pairs with equal keys and ``low`` <= right[at] <= ``high``; the range spans at most ``width``.

    Left rows go to the one or two blocks of ``width`` that their range can touch, so only rows of one
    block meet.
    """
    block = F.floor(low / width).cast("long")
    spread = left.withColumn("_low", low).withColumn("_high", high).withColumn("_block", F.explode(F.array_distinct(F.array(block, block + 1))))
    placed = right.withColumn("_block", F.floor(F.col(at) / width).cast("long"))
    met = spread.join(placed, [*keys, "_block"]).where((F.col(at) >= F.col("_low")) & (F.col(at) <= F.col("_high")))
    return met.drop("_block", "_low", "_high")


def zip_strict(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of two series joined by position; both have idx. The query fails where one series is longer than the other."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), [*keys, "idx"], "full")
    place = F.when(F.col("_l") & F.col("_r"), F.col("idx")).otherwise(F.raise_error("series of different lengths"))
    return both.withColumn("idx", place).drop("_l", "_r")
