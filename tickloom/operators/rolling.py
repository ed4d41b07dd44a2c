"""Rolling features of candle series with idx."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.patterns import true_range
from tickloom.operators.series import bounded, full, last_n, running


def observation_columns(bars: DataFrame) -> DataFrame:
    """Returns against the previous close, and the hour and weekday as points on a circle."""
    prices = ("open", "high", "low", "close")
    out = bounded(bars, lambda w: {f"ret_{c}": F.col(c) / F.lag("close").over(w) - 1 for c in prices}, back=1)
    day = 2 * F.pi() * (F.hour("time") + F.minute("time") / 60) / 24
    week = 2 * F.pi() * (F.weekday("time") + 1) / 7
    return out.withColumns({"hour_sin": F.sin(day), "hour_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)})


def returns(bars: DataFrame) -> DataFrame:
    return bounded(bars, lambda w: {"ret": F.col("close") / F.lag("close").over(w) - 1}, back=1)


def volatility_momentum(bars: DataFrame, spans: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Sample deviation and sum of the last n returns; 0 until n are there."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for n in spans:
            out[f"vol_{n}"] = F.coalesce(full(F.stddev_samp("ret").over(last_n(w, n)), n, 1), F.lit(0.0))
            out[f"mom_{n}"] = F.coalesce(full(F.sum("ret").over(last_n(w, n)), n, 1), F.lit(0.0))
        return out

    return bounded(returns(bars), columns, back=max(spans) - 1)


def scalping(bars: DataFrame, fast: int = 5, slow: int = 12, mean: int = 20, atr: int = 14) -> DataFrame:
    """Rates of change (period k looks k - 1 bars back, and needs more than k bars), mean reversion, mean range, body ratio."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        close, span = F.col("close"), F.col("high") - F.col("low")
        deviation = (close - F.avg("close").over(last_n(w, mean))) / F.nullif(F.stddev_pop("close").over(last_n(w, mean)), F.lit(0.0))
        ratio = F.sum(F.abs(close - F.col("open"))).over(last_n(w, atr)) / F.nullif(F.sum(span).over(last_n(w, atr)), F.lit(0.0))
        return {
            "roc_fast": F.when(F.col("idx") >= fast, close / F.lag("close", fast - 1).over(w) - 1),
            "roc_slow": F.when(F.col("idx") >= slow, close / F.lag("close", slow - 1).over(w) - 1),
            "mean_rev_z": full(F.coalesce(deviation, F.lit(0.0)), mean),
            "atr": full(F.avg(span).over(last_n(w, atr)), atr),
            "body_ratio": full(F.coalesce(ratio, F.lit(0.0)), atr),
        }

    return bounded(bars, columns, back=max(slow, mean, atr))


def streak(df: DataFrame, sign: str, most: int) -> DataFrame:
    """``streak``: signed length of the run of equal ``sign`` up to each row, at most ``most``."""
    turned = bounded(df, lambda w: {"_turn": F.when(F.col(sign) == F.lag(sign).over(w), None).otherwise(F.col("idx"))}, back=1)
    begun = running(turned, {"_begin": ("last", F.col("_turn"))})
    length = F.least(F.col("idx") - F.col("_begin") + 1, F.lit(most))
    return begun.withColumn("streak", (F.col(sign) * length).cast("long")).drop("_turn", "_begin")


def spread_z(w: WindowSpec, n: int) -> Column:
    """Deviation of the spread from its mean over the last n bars; 0 with fewer than two bars or no spread of spreads."""
    wide = F.nullif(F.round(F.stddev_pop("spread").over(last_n(w, n)), 9), F.lit(0.0))
    z = (F.col("spread") - F.avg("spread").over(last_n(w, n))) / wide
    return F.when(F.col("idx") >= 1, F.coalesce(z, F.lit(0.0))).otherwise(0.0)


def indicators(bars: DataFrame) -> DataFrame:
    """Non-recursive indicators: RSI from simple means, z-score, position in the band, range ratio, wick and body."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        close, span = F.col("close"), F.col("high") - F.col("low")
        up, move = F.sum(F.greatest("diff", F.lit(0.0))).over(last_n(w, 14)), F.sum(F.abs("diff")).over(last_n(w, 14))
        mean, deviation = F.avg("close").over(last_n(w, 20)), F.stddev_pop("close").over(last_n(w, 20))
        zero = F.lit(0.0)
        return {
            "rsi_sma": full(F.coalesce(100 * up / F.nullif(move, zero), F.lit(50.0)), 14, 1),
            "z60": full((close - F.avg("close").over(last_n(w, 60))) / F.nullif(F.stddev_samp("close").over(last_n(w, 60)), zero), 60),
            "pct_b": full((close - (mean - 2 * deviation)) / F.nullif(4 * deviation, zero), 20),
            "roc6": close / F.lag("close", 6).over(w) - 1,
            "range_ratio": full(F.avg(span).over(last_n(w, 6)) / F.nullif(F.avg(span).over(last_n(w, 30)), zero), 30),
            "upper_wick": F.coalesce((F.col("high") - F.greatest("open", "close")) / F.nullif(span, zero), zero),
            "wicks": F.coalesce((span - F.abs(close - F.col("open"))) / F.nullif(span, zero), zero),
            "body": F.coalesce(F.abs(close - F.col("open")) / F.nullif(span, zero), zero),
            "hour_sin": F.sin(day),
            "hour_cos": F.cos(day),
        }

    day = 2 * F.pi() * (F.hour("time") + F.minute("time") / 60) / 24
    moved = bounded(bars, lambda w: {"diff": F.col("close") - F.lag("close").over(w)}, back=1)
    return bounded(moved, columns, back=60)


def future_up(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Whether the next h returns sum to more than 0; null where fewer than h follow."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for h in horizons:
            ahead = w.rowsBetween(1, h)
            out[f"up_{h}"] = F.when(F.count("ret").over(ahead) == h, (F.round(F.sum("ret").over(ahead), 9) > 0).cast("int"))
        return out

    return bounded(returns(bars), columns, ahead=max(horizons))


def recursive_mean(df: DataFrame, values: dict[str, Column], n: int, first: int = 0) -> DataFrame:
    """Add x(t) = v(t) / n + (1 - 1 / n) x(t - 1) for each value, beginning with v at row ``first``.

    A chunk is as long as it takes the weight of a row to fall to 1e-8. Within it the recursion is a weighted running
    sum; what the three chunks before carry over is joined in, and all older rows weigh less than a double can hold.
    """
    share, keep = 1 / n, 1 - 1 / n
    rows = max(1, int(-8 / math.log10(keep)))
    at = F.pmod(F.col("idx"), F.lit(rows))
    weighed = {f"_v_{c}": F.when(F.col("idx") > first, v).when(F.col("idx") == first, v * n) * F.pow(F.lit(keep), -at.cast("double")) for c, v in values.items()}
    chunked = df.withColumns({**weighed, "_part": F.floor(F.col("idx") / rows)})
    upto = Window.partitionBy("instrument", "_part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({f"_s_{c}": F.sum(f"_v_{c}").over(upto) * share * F.pow(F.lit(keep), at.cast("double")) for c in values})
    ends = local.groupBy("instrument", F.col("_part").alias("idx")).agg(*[F.max_by(f"_s_{c}", "idx").alias(c) for c in values])
    whole = keep**rows

    def carried(w: WindowSpec) -> dict[str, Column]:
        return {f"_c_{c}": sum((F.coalesce(F.lag(c, k + 1).over(w), F.lit(0.0)) * whole**k for k in range(3)), F.lit(0.0)) for c in values}

    carry = bounded(ends, carried, back=3).select("instrument", F.col("idx").alias("_part"), *[f"_c_{c}" for c in values])
    joined = local.join(carry, ["instrument", "_part"])
    out = {c: F.when(F.col("idx") >= first, F.coalesce(f"_s_{c}", F.lit(0.0)) + F.col(f"_c_{c}") * F.pow(F.lit(keep), at.cast("double") + 1)) for c in values}
    return joined.withColumns(out).drop("_part", *[f"_{k}_{c}" for c in values for k in "vsc"])


def smoothed(bars: DataFrame, n: int = 14) -> DataFrame:
    """Recursively smoothed indicators: ATR of n, 6 and 30 bars, RSI and ADX of n."""

    def moves(w: WindowSpec) -> dict[str, Column]:
        up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
        diff, zero = F.col("close") - F.lag("close").over(w), F.lit(0.0)
        return {
            "_gain": F.when(diff > 0, diff).when(diff.isNotNull(), zero),
            "_loss": F.when(diff < 0, -diff).when(diff.isNotNull(), zero),
            "_plus": F.when((up > down) & (up > 0), up).when(up.isNotNull(), zero),
            "_minus": F.when((down > up) & (down > 0), down).when(down.isNotNull(), zero),
            "_tr": true_range(w),
        }

    own = bounded(bars.select("instrument", "time", "idx", "high", "low", "close"), moves, back=1)
    for length in (n, 6, 30):
        own = recursive_mean(own, {f"atr{length}_rma": F.col("_tr")}, length)
    own = recursive_mean(own, {f"_m{c}": F.col(c) for c in ("_gain", "_loss", "_plus", "_minus")}, n, 1)
    total = F.col("_m_plus") + F.col("_m_minus")
    crossed = own.withColumn("_dx", F.when(F.col("idx") >= 1, F.coalesce(100 * F.abs(F.col("_m_plus") - F.col("_m_minus")) / F.nullif(total, F.lit(0.0)), F.lit(0.0))))
    out = recursive_mean(crossed, {"adx": F.col("_dx")}, n, 1)
    rsi = 100 * F.col("_m_gain") / F.nullif(F.col("_m_gain") + F.col("_m_loss"), F.lit(0.0))
    ratio = F.col("atr6_rma") / F.nullif(F.col("atr30_rma"), F.lit(0.0))
    return out.select("instrument", "time", "idx", F.col(f"atr{n}_rma").alias("atr_rma"), "atr30_rma", ratio.alias("atr_ratio"), rsi.alias("rsi_rma"), "adx")
