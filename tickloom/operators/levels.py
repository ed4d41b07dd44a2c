"""Features from price levels that live for a while, on one timeframe, seen at rows of another.

A timeframe's state after each of its bars: open gaps, order blocks and liquidity pools with the bars at which they
begin and end, the last confirmed swings, trend, recency of breaks and displacements, mean range. Rows that look at it
say which bar they see (``at_idx``) and from which price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.market import price_zone
from tickloom.operators import patterns as P
from tickloom.operators.asof import range_join
from tickloom.operators.series import bounded, last_n, running
from tickloom.operators.touch import first_touch
from tickloom.sources.scratch import stored

#: Bars over which the mean range of a timeframe is taken; fewer at its beginning.
RANGE_BARS = 14


def _directed(kind: str) -> F.Column:
    return F.when(F.col(kind) == "bullish", 1.0).otherwise(-1.0)


def live_levels(bars: DataFrame, age: int, tolerance: float = 0.1) -> DataFrame:
    """Of ``flagged`` bars, levels as sort (gap, block, pool), middle, direction, level_idx, begins and ends (first bar at which it is gone).

    A level is gone when it is more than ``age`` bars old; a gap also when it is mitigated, a pool when a bar, that of
    its confirmation included, trades through its price.
    """
    gaps = P.gaps_of(bars)
    gap = P.first_hit(gaps, bars, *P.mitigation(gaps)).select(
        "instrument", F.lit("gap").alias("sort"), ((F.col("top") + F.col("bottom")) / 2).alias("middle"), _directed("kind").alias("direction"), F.col("idx").alias("level_idx"), F.col("confirmed_idx").alias("begins"), "hit_idx"
    )
    none = F.lit(None).cast("long")
    block = P.order_blocks_of(bars).select(
        "instrument", F.lit("block").alias("sort"), ((F.col("top") + F.col("bottom")) / 2).alias("middle"), _directed("kind").alias("direction"), F.col("idx").alias("level_idx"), F.col("confirmed_idx").alias("begins"), none.alias("hit_idx")
    )
    asked = P.liquidity_of(P.swings_of(bars), tolerance=tolerance).select("instrument", "price", "idx", "confirmed_idx", (F.col("confirmed_idx") - 1).alias("after"), F.col("price").alias("from"), F.col("price").alias("to"))
    swept = first_touch(asked, bars.select("instrument", "idx", F.col("low").alias("lo"), F.col("high").alias("hi")))
    pool = swept.select("instrument", F.lit("pool").alias("sort"), F.col("price").alias("middle"), F.lit(0.0).alias("direction"), F.col("idx").alias("level_idx"), F.col("confirmed_idx").alias("begins"), "hit_idx")
    every = gap.unionByName(block).unionByName(pool)
    return every.withColumn("ends", F.least("hit_idx", F.col("level_idx") + age + 1)).drop("hit_idx").where("ends > begins")


def bar_state(bars: DataFrame, lookback: int) -> DataFrame:
    """Of ``armed`` bars: instrument, at_idx, mean_range, hi, lo, trend, and whether a break of either kind or a displacement is recent."""
    event = F.struct("rank", "direction", "kind")
    breaks = P.breaks_of(bars).groupBy("instrument", "idx").agg(F.array_sort(F.collect_list(event)).alias("found"))
    joined = bars.withColumn("moved", P.confirmed_here()["displacement"].cast("int")).join(breaks, ["instrument", "idx"], "left")
    last = running(joined, {"trend": ("last", F.try_element_at("found", F.lit(-1))["direction"])})

    def recent(w):
        back = w.rowsBetween(-lookback, 0)
        return {
            "recent": F.flatten(F.collect_list("found").over(back)),
            "displaced": F.coalesce(F.max("moved").over(back), F.lit(0)),
            "mean_range": F.avg(F.col("high") - F.col("low")).over(last_n(w, RANGE_BARS)),
        }

    seen = bounded(last, recent, back=max(lookback, RANGE_BARS))
    return seen.select(
        "instrument",
        F.col("idx").alias("at_idx"),
        "mean_range",
        "hi",
        "lo",
        F.when(F.col("trend") == "bullish", 1.0).when(F.col("trend") == "bearish", -1.0).otherwise(0.0).alias("trend"),
        F.exists("recent", lambda e: e["kind"] == "BOS").cast("double").alias("bos_recent"),
        F.exists("recent", lambda e: e["kind"] == "CHOCH").cast("double").alias("choch_recent"),
        F.col("displaced").cast("double").alias("displacement_recent"),
    )


#: The names that features give the sorts of levels.
SORTS = {"fvg": "gap", "ob": "block", "liq": "pool"}


def level_state(bars: DataFrame, age: int, lookback: int, tolerance: float = 0.1) -> DataFrame:
    """``bar_state`` after each bar, with its live levels of each sort as a list; all patterns come from one stored table.

    A list holds at most two levels of each of the last ``age`` + 1 bars, however long the series is.
    """
    known = stored(P.armed(P.flagged(bars)), "armed-bars")
    levels = live_levels(known, age, tolerance)
    met = range_join(levels, known.select("instrument", F.col("idx").alias("at_idx")), ["instrument"], "at_idx", F.col("begins"), F.col("ends") - 1, age + 1)
    level = F.struct("middle", "direction", "level_idx")
    held = met.groupBy("instrument", "at_idx").agg(*[F.collect_list(F.when(F.col("sort") == s, level)).alias(n) for n, s in SORTS.items()])
    return bar_state(known, lookback).join(held, ["instrument", "at_idx"], "left")


def seen_from(price: Column, state: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Ten features of a bar's ``level_state`` from a price; all 0 where no bar is seen yet.

    Distances are in mean ranges (in prices while that is 0); of levels as near as each other the older counts.
    """

    def nearest(name: str) -> Column:
        away = F.transform(state(name), lambda one: F.struct(F.round(F.abs(price - one["middle"]), 6), one["level_idx"], F.abs(price - one["middle"]).alias("d"), one["direction"].alias("direction")))
        return F.array_min(away)

    span, zero = F.when(state("mean_range") > 0, state("mean_range")).otherwise(1.0), F.lit(0.0)
    zone = price_zone(price, state("lo"), state("hi"))
    out = {f"{n}_distance": F.coalesce(nearest(n)["d"] / span, zero) for n in SORTS}
    out |= {f"{n}_direction": F.coalesce(nearest(n)["direction"], zero) for n in ("fvg", "ob")}
    out |= {c: F.coalesce(state(c), zero) for c in ("bos_recent", "choch_recent", "trend", "displacement_recent")}
    out["premium_discount"] = F.when(zone == "premium", 1.0).when(zone == "discount", -1.0).otherwise(0.0)
    return out


def level_features(views: DataFrame, bars: DataFrame, age: int, lookback: int, tolerance: float = 0.1) -> DataFrame:
    """The features of ``seen_from`` for each view (instrument, time, price, at_idx) of a timeframe's bars."""
    ready = views.join(level_state(bars, age, lookback, tolerance), ["instrument", "at_idx"], "left")
    return ready.select("instrument", "time", *[c.alias(n) for n, c in seen_from(F.col("price")).items()])
