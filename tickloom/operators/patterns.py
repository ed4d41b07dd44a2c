"""Price patterns of candle series as window expressions: one row for each event.

All take candles with idx. ``idx`` of an event is the bar that the pattern belongs to, ``confirmed_idx``
the bar at which it is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.series import bounded, full, last_n, running, with_index
from tickloom.operators.touch import first_touch
from tickloom.sources.scratch import stored


def true_range(window: WindowSpec) -> Column:
    before = F.lag("close").over(window)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, n: int = 14, first: int = 0) -> DataFrame:
    """``atr``: mean of the last n true ranges, from bar ``first`` + n - 1 on."""
    ranged = bounded(bars, lambda w: {"tr": true_range(w)}, back=1)
    return bounded(ranged, lambda w: {"atr": full(F.avg("tr").over(last_n(w, n)), n, first)}, back=n - 1)


def _swing_columns(left: int, right: int):
    def flags(w: WindowSpec) -> dict[str, Column]:
        before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
        whole = (F.count("high").over(before) == left) & (F.count("high").over(after) == right)
        return {
            "is_high": whole & (F.col("high") >= F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after)),
            "is_low": whole & (F.col("low") <= F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after)),
        }

    return flags


def swing_flags(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """``is_high`` and ``is_low``: no higher high (lower low) among ``left`` bars before and ``right`` after, ties allowed."""
    return bounded(bars, _swing_columns(left, right), back=left, ahead=right)


def flagged(bars: DataFrame, left: int = 2, right: int = 2, n: int = 14) -> DataFrame:
    """What all patterns need to know of a bar's neighbours, from one shuffle; the ``_of`` functions take it.

    ``tr``, ``atr`` (from bar n - 1 on), ``atr_known`` (from bar n on), ``is_high``, ``is_low``, ``ch`` and ``cl`` (the swing that
    this bar confirms), and of the bars one and two before ``time1``, ``open1`` ... ``low1``, ``high2``, ``low2``.
    """

    def near(w: WindowSpec) -> dict[str, Column]:
        one = {f"{c}1": F.lag(c).over(w) for c in ("time", "open", "high", "low", "close")}
        return one | {"tr": true_range(w), "high2": F.lag("high", 2).over(w), "low2": F.lag("low", 2).over(w)} | _swing_columns(left, right)(w)

    def far(w: WindowSpec) -> dict[str, Column]:
        mean = F.avg("tr").over(last_n(w, n))
        return {
            "atr": full(mean, n),
            "atr_known": full(mean, n, 1),
            "ch": F.lag(F.when(F.col("is_high"), F.col("high")), right).over(w),
            "cl": F.lag(F.when(F.col("is_low"), F.col("low")), right).over(w),
        }

    return bounded(bars, [near, far], back=max(n, left + right, 2), ahead=right)


def armed(flags: DataFrame) -> DataFrame:
    """Add the last confirmed swings ``hi`` and ``lo``, and how many there were, to ``flagged`` bars."""
    return running(
        flags,
        {
            "n_hi": ("sum", F.col("ch").isNotNull().cast("long")),
            "n_lo": ("sum", F.col("cl").isNotNull().cast("long")),
            "hi": ("last", F.col("ch")),
            "lo": ("last", F.col("cl")),
        },
    )


def swings(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    return swings_of(swing_flags(bars, left, right), right)


def swings_of(flags: DataFrame, right: int = 2) -> DataFrame:
    both = F.array(
        F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))),
    )
    events = flags.withColumn("event", F.explode(F.array_compact(both)))
    return events.select("instrument", "time", "idx", (F.col("idx") + right).alias("confirmed_idx"), "event.kind", "event.price")


def gaps(bars: DataFrame) -> DataFrame:
    """Fair value gaps: the bar's low above the high two bars before (bullish), or its high below that low (bearish)."""
    return gaps_of(flagged(bars))


def _gap_sides() -> tuple[Column, Column]:
    return F.col("low") > F.col("high2"), F.col("high") < F.col("low2")


def gaps_of(flags: DataFrame) -> DataFrame:
    up, down = _gap_sides()
    return flags.where(up | down).select(
        "instrument",
        F.col("time1").alias("time"),
        (F.col("idx") - 1).alias("idx"),
        F.col("idx").alias("confirmed_idx"),
        F.when(up, "bullish").otherwise("bearish").alias("kind"),
        F.when(up, F.col("low")).otherwise(F.col("low2")).alias("top"),
        F.when(up, F.col("high2")).otherwise(F.col("high")).alias("bottom"),
    )


def _is_displaced(threshold: float) -> Column:
    body = F.abs(F.col("close") - F.col("open"))
    return F.col("atr_known").isNotNull() & (body >= F.col("atr_known") * threshold) & (body > 0)


def displacements(bars: DataFrame, threshold: float = 1.5, n: int = 14) -> DataFrame:
    """Bars whose body is ``threshold`` or more average ranges."""
    return displacements_of(flagged(bars, n=n), threshold)


def displacements_of(flags: DataFrame, threshold: float = 1.5) -> DataFrame:
    kind = F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish")
    body = F.abs(F.col("close") - F.col("open"))
    return flags.where(_is_displaced(threshold)).select(
        "instrument", "time", "idx", F.col("idx").alias("confirmed_idx"), kind.alias("kind"), body.alias("body"), F.col("atr_known").alias("atr")
    )


def _is_block(factor: float) -> Column:
    body, before = F.col("close") - F.col("open"), F.col("close1") - F.col("open1")
    return (F.abs(body) > F.col("atr_known") * factor) & (((body > 0) & (before < 0)) | ((body < 0) & (before > 0)))


def order_blocks(bars: DataFrame, factor: float = 2.0, n: int = 14) -> DataFrame:
    """The bar before an opposite body of more than ``factor`` average ranges."""
    return order_blocks_of(flagged(bars, n=n), factor)


def order_blocks_of(flags: DataFrame, factor: float = 2.0) -> DataFrame:
    return flags.where(_is_block(factor)).select(
        "instrument",
        F.col("time1").alias("time"),
        (F.col("idx") - 1).alias("idx"),
        F.col("idx").alias("confirmed_idx"),
        F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish").alias("kind"),
        F.col("high1").alias("top"),
        F.col("low1").alias("bottom"),
    )


def confirmed_here(threshold: float = 1.5, factor: float = 2.0) -> dict[str, Column]:
    """Whether a ``flagged`` bar confirms a gap, a block or a displacement."""
    up, down = _gap_sides()
    found = {"gap": up | down, "block": _is_block(factor), "displacement": _is_displaced(threshold)}
    return {n: F.coalesce(c, F.lit(False)) for n, c in found.items()}


def structure_breaks(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Breaks of the last confirmed swing: the first bar beyond it; BOS in the direction of the break before, else CHOCH."""
    return breaks_of(armed(flagged(bars, left, right)))


def breaks_of(armed_bars: DataFrame) -> DataFrame:
    """``structure_breaks`` of bars that are ``armed``."""

    def beyond(epoch: str, level: str, hit: Column, rank: int, direction: str) -> Column:
        event = F.struct(F.col(epoch).alias("epoch"), F.col(level).alias("level"), F.lit(rank).alias("rank"), F.lit(direction).alias("direction"))
        return F.when((F.col(epoch) > 0) & hit, event)

    sides = F.array(beyond("n_hi", "hi", F.col("high") > F.col("hi"), 0, "bullish"), beyond("n_lo", "lo", F.col("low") < F.col("lo"), 1, "bearish"))
    found = armed_bars.select("instrument", "time", "idx", F.explode(F.array_compact(sides)).alias("side")).select("instrument", "time", "idx", "side.*")
    first = found.groupBy("instrument", "rank", "direction", "epoch").agg(F.min("idx").alias("bar"), F.min_by("time", "idx").alias("time"), F.min("level").alias("level"))
    numbered = with_index(first, order=("time", "rank"))
    seen = bounded(numbered, lambda w: {"before": F.lag("direction").over(w)}, back=1)
    kind = F.when(F.col("before").isNull() | (F.col("before") == F.col("direction")), "BOS").otherwise("CHOCH")
    return seen.select("instrument", "time", F.col("bar").alias("idx"), "rank", "direction", kind.alias("kind"), "level")


def final_trend(bars: DataFrame, breaks: DataFrame) -> DataFrame:
    """Direction of each instrument's last break, ``undefined`` where it has none."""
    last = breaks.groupBy("instrument").agg(F.max_by("direction", F.struct("idx", "rank")).alias("trend"))
    return bars.select("instrument").distinct().join(last, "instrument", "left").withColumn("trend", F.coalesce("trend", F.lit("undefined")))


def liquidity(bars: DataFrame, left: int = 2, right: int = 2, lookback: int = 20, tolerance: float = 0.1, min_touches: int = 2) -> DataFrame:
    """Swings whose level was touched before by like swings within ``tolerance`` percent, among the last ``lookback``."""
    return liquidity_of(swings(bars, left, right), lookback, tolerance, min_touches)


def liquidity_of(swung: DataFrame, lookback: int = 20, tolerance: float = 0.1, min_touches: int = 2) -> DataFrame:
    like = ("instrument", "kind")
    numbered = with_index(swung.withColumnRenamed("idx", "bar"), like)
    seen = bounded(numbered, lambda w: {"before": F.collect_list("price").over(w.rowsBetween(-lookback, -1))}, back=lookback, keys=like)
    price = F.col("price")
    touches = F.size(F.filter("before", lambda p: F.abs(p - price) <= price * tolerance / 100)) + 1
    return seen.withColumn("touches", touches.cast("long")).where(F.col("touches") >= min_touches).select(
        "instrument", "time", F.col("bar").alias("idx"), "confirmed_idx", "kind", "price", "touches"
    )


def first_hit(levels: DataFrame, bars: DataFrame, low: Column, high: Column) -> DataFrame:
    """``hit_idx``: the first bar after ``confirmed_idx``, however far, whose range meets ``low`` to ``high``; null if none."""
    queries = levels.withColumns({"after": F.col("confirmed_idx"), "from": low, "to": high})
    rows = bars.select("instrument", "idx", F.col("low").alias("lo"), F.col("high").alias("hi"))
    return first_touch(queries, rows).drop("after", "from", "to")


def mitigation(gaps: DataFrame) -> tuple[Column, Column]:
    """The prices that end a gap: at or below the bottom of a bullish one, at or above the top of a bearish one."""
    up, far = F.col("kind") == "bullish", float("inf")
    return F.when(up, F.lit(-far)).otherwise(F.col("top")), F.when(up, F.col("bottom")).otherwise(F.lit(far))


def all_events(frames: dict[str, DataFrame], tolerance: float = 0.1) -> DataFrame:
    """Events of every detector for each instrument and timeframe: instrument, timeframe, detector, kind, idx, time.

    ``frames`` gives the bars (with idx) of each timeframe. A series is an instrument at one timeframe; all series go
    through one plan, whatever their number, and their bars are flagged and stored once.
    """
    ohlc = ("time", "idx", "open", "high", "low", "close")
    series = [df.select(F.struct("instrument", F.lit(name).alias("timeframe")).alias("instrument"), *ohlc) for name, df in frames.items()]
    known = stored(armed(flagged(reduce(DataFrame.unionByName, series))), "armed-bars")
    found = {
        "swing": swings_of(known),
        "gap": gaps_of(known),
        "block": order_blocks_of(known),
        "displacement": displacements_of(known),
        "pool": liquidity_of(swings_of(known), tolerance=tolerance),
        "break": breaks_of(known).withColumn("kind", F.concat_ws(" ", "direction", "kind")),
    }
    events = [df.select("instrument.*", F.lit(name).alias("detector"), "kind", "idx", "time") for name, df in found.items()]
    return reduce(DataFrame.unionByName, events)
