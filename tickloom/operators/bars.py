"""Ticks to candles, roll-ups, count candles, merging of candle sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import KEYS, with_index


def tick_columns(df: DataFrame) -> DataFrame:
    """Mid price and spread of quotes."""
    return df.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def candles(ticks: DataFrame, width: str, price: Column | None = None) -> DataFrame:
    """Epoch-aligned candles of ``width`` from ticks (instrument, time, seq, bid, ask, mid); empty buckets give none."""
    at, price = F.struct("time", "seq"), F.col("mid") if price is None else price
    grouped = ticks.groupBy("instrument", F.window("time", width).alias("bucket"))  # the whole window, which a watermark can close
    return grouped.agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").alias("tick_count"),
        F.max_by(F.col("ask") - F.col("bid"), at).alias("spread"),
    ).select("instrument", F.col("bucket.start").alias("time"), "open", "high", "low", "close", "tick_count", "spread")


def roll_up(bars: DataFrame, width: str) -> DataFrame:
    """Wider candles from narrower ones: sums of ticks and volume, mean spread."""
    volume = [F.sum("volume").alias("volume")] if "volume" in bars.columns else []
    grouped = bars.groupBy("instrument", F.window("time", width)["start"].alias("bucket"))
    return grouped.agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("tick_count").alias("tick_count"),
        *volume,
        F.avg("spread").alias("spread"),
    ).withColumnRenamed("bucket", "time")


def count_candles(bars: DataFrame, n: int) -> DataFrame:
    """Every n bars, whatever their times, make one; an incomplete last group makes none. ``bars`` has idx."""
    grouped = bars.groupBy("instrument", F.floor(F.col("idx") / n).cast("long").alias("group"))
    out = grouped.agg(
        F.count("*").alias("n"),
        F.min("time").alias("time"),
        F.min_by("open", "idx").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "idx").alias("close"),
        F.sum("tick_count").alias("tick_count"),
    )
    return out.where(F.col("n") == n).drop("n")


def distinct_on(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def merge_sources(preferred: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both; where both have one, the row of ``preferred``."""
    both = preferred.withColumn("_source", F.lit(1)).unionByName(other.withColumn("_source", F.lit(2)))
    return distinct_on(both, keys, "_source").drop("_source")


def upsert(stored: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins on the key."""
    return merge_sources(loaded, stored, keys)


def insert_ignore(stored: DataFrame, loaded: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The stored rows, and the first loaded row of each new key."""
    new = loaded.join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(distinct_on(new, keys, *order))


def indexed_candles(ticks: DataFrame, width: str) -> DataFrame:
    return with_index(candles(ticks, width), KEYS)
