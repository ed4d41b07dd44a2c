"""Quotes beside the bars closed before them: what a quote may know of each width, and of the bar that it is in.

Wider bars are made of a number of base bars, so after ``closed`` base bars the last wide bar of ``n`` has number
closed // n - 1: states join by number, no as-of join is needed, and the quotes themselves move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.market import killzone
from tickloom.operators.bars import candles, count_candles
from tickloom.operators.levels import level_state, seen_from
from tickloom.operators.rolling import scalping, streak
from tickloom.operators.series import bounded, last_n, running, with_index
from tickloom.sources.scratch import stored

View = tuple[DataFrame, dict[str, Column]]


@dataclass(frozen=True)
class Quotes:
    """``rows``: quotes with ``closed`` and their own bar so far; ``bars``: candles with idx by number of base bars."""

    rows: DataFrame
    bars: dict[int, DataFrame]
    width_s: int

    @classmethod
    def over(cls, ticks: DataFrame, width_s: int, widths: tuple[int, ...]) -> Quotes:
        """Of ticks (instrument, time, seq, mid, bid, ask); a bar with a third of all ticks is still cut into chunks."""
        width = f"{width_s} seconds"
        base = stored(with_index(candles(ticks, width)), "bars")
        placed = with_index(ticks, order=("time", "seq"), block="1 day").withColumn("begin", F.window("time", width)["start"])
        mid = F.col("mid")
        so_far = running(placed, {"so_high": ("max", mid), "so_low": ("min", mid), "so_many": ("sum", F.lit(1))}, keys=("instrument", "begin"))
        numbers = base.select("instrument", F.col("time").alias("begin"), F.col("idx").alias("closed"))
        rows = so_far.drop("idx").join(numbers, ["instrument", "begin"])
        return cls(rows, {1: base} | {n: count_candles(base, n).withColumnRenamed("group", "idx") for n in widths if n > 1}, width_s)

    def after(self, states: dict[int, DataFrame]) -> DataFrame:
        """For each instrument and ``closed``, the state of the last closed bar of each width as a struct ``of_<width>``."""
        out = self.bars[1].select("instrument", F.col("idx").alias("closed"))
        for n, state in states.items():
            held = F.struct(*[c for c in state.columns if c not in ("instrument", "idx")]).alias(f"of_{n}")
            numbered = out.withColumn("idx", (F.floor(F.col("closed") / n) - 1).cast("long"))
            out = numbered.join(state.select("instrument", "idx", held), ["instrument", "idx"], "left").drop("idx")
        return out


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def quote_view(quotes: Quotes, own: dict[str, float]) -> View:
    """Spread, its deviation from the closing spreads of the last bars (two or more), the bar so far, and the mid price."""
    n = own["spread_avg_period"]

    def columns(w):
        return {"mean": F.avg("spread").over(last_n(w, n)), "deviation": F.round(F.stddev_pop("spread").over(last_n(w, n)), 9)}

    state = bounded(quotes.bars[1], columns, back=n - 1).select("instrument", "idx", F.when(F.col("idx") >= 1, F.col("mean")).alias("mean"), "deviation")
    held, spread, span = F.col("tick.of_1"), F.col("ask") - F.col("bid"), F.col("so_high") - F.col("so_low")
    passed = (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1_000_000
    return quotes.after({1: state}), {
        "spread": spread,
        "spread_z": _zero((spread - held["mean"]) / F.nullif(held["deviation"], F.lit(0.0))),
        "partial_range": span,
        "position_in_range": F.when(span > 0, (F.col("mid") - F.col("so_low")) / span).otherwise(0.5),
        "elapsed_pct": F.least(passed / quotes.width_s, F.lit(1.0)),
        "tick_count": F.col("so_many").cast("double"),
        "mid": F.col("mid"),
    }


def scalp_view(widths: tuple[int, ...]):
    def view(quotes: Quotes, own: dict[str, float]) -> View:
        """Seven features of each width; 0 until a width has bars enough, and the ratio of ranges for base bars alone."""
        mean, atr, most = own["mean_rev_period"], own["atr_period"], max(own["roc_slow"], own["mean_rev_period"], own["atr_period"]) + 1

        def closes(w):
            whole = F.col("idx") >= mean - 1
            return {"mean": F.when(whole, F.avg("close").over(last_n(w, mean))), "deviation": F.round(F.stddev_pop("close").over(last_n(w, mean)), 9)}

        states, out = {}, {}
        for n in widths:
            known = bounded(scalping(quotes.bars[n], own["roc_fast"], own["roc_slow"], mean, atr), closes, back=mean - 1)
            signed = streak(known.withColumn("dir", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)), "dir", most)
            states[n] = signed.select("instrument", "idx", "roc_fast", "roc_slow", "mean", "deviation", "atr", "body_ratio", "streak")
            held = F.col(f"scalp.of_{n}")
            out[f"x{n}_roc_fast"], out[f"x{n}_roc_slow"] = _zero(held["roc_fast"]), _zero(held["roc_slow"])
            out[f"x{n}_mean_rev_z"] = _zero((F.col("mid") - held["mean"]) / F.nullif(held["deviation"], F.lit(0.0)))
            out[f"x{n}_atr"], out[f"x{n}_body_ratio"] = _zero(held["atr"]), _zero(held["body_ratio"])
            span = F.col("so_high") - F.col("so_low")
            out[f"x{n}_range_ratio"] = _zero(span / F.nullif(held["atr"], F.lit(0.0))) if n == 1 else F.lit(0.0)
            out[f"x{n}_direction_streak"] = _zero(held["streak"].cast("double"))
        return quotes.after(states), out

    return view


def level_view(widths: tuple[int, ...], tolerance: float):
    def view(quotes: Quotes, own: dict[str, float]) -> View:
        """Ten features of each width from the mid price, and whether the quote is in a killzone."""
        states = {n: level_state(quotes.bars[n], own["level_max_age"], own["lookback"], tolerance).withColumnRenamed("at_idx", "idx") for n in widths}
        out = {}
        for n in widths:
            seen = seen_from(F.col("mid"), lambda c, n=n: F.col(f"ict.of_{n}")[c])
            out |= {f"x{n}_{c}": value for c, value in seen.items()}
        return quotes.after(states), out | {"killzone": (killzone(F.hour("time")) != "none").cast("double")}

    return view
