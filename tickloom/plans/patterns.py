"""Queries: candles, roll-ups, pattern detectors, rolling features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import patterns as P
from tickloom.operators.series import bounded, full, last_n, running, with_index
from tickloom.plans.base import BARS, TICKS, bars, bars_sql, query, raw_bars, rounded, ticks
from tickloom.sources.scratch import stored

OHLC = ("open", "high", "low", "close")
R_OHLC = ", ".join(f"round({c}, 6) AS {c}" for c in OHLC)
W = "(PARTITION BY instrument ORDER BY idx)"


def frame(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("ticks_to_candles", f"WITH {TICKS}, {bars_sql('bars', '10 minutes')} SELECT instrument, time, {R_OHLC}, tick_count, round(spread, 6) AS spread FROM bars")
def ticks_to_candles(spark, sf_dir):
    return raw_bars(spark, sf_dir, "10 minutes").select("instrument", "time", *rounded(*OHLC), "tick_count", *rounded("spread"))


def _rolled_sql(name, width):
    return f"""{name} AS (SELECT instrument, time_bucket(INTERVAL '{width}', time) AS time, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low,
      last(close ORDER BY time) AS close, sum(tick_count)::BIGINT AS tick_count, avg(spread) AS spread FROM bars GROUP BY 1, 2)"""


def _rolled(width):
    def run(spark, sf_dir):
        out = B.roll_up(raw_bars(spark, sf_dir, "10 minutes"), width)
        return out.select("instrument", "time", *rounded(*OHLC), "tick_count", *rounded("spread"))

    return run


for _name, _width in (("candles_to_m1", "30 minutes"), ("rollup_h1", "1 hour"), ("rollup_h4", "4 hours"), ("rollup_d1", "1 day")):
    query(_name, f"WITH {TICKS}, {bars_sql('bars', '10 minutes')}, {_rolled_sql('rolled', _width)} SELECT instrument, time, {R_OHLC}, tick_count, round(spread, 6) AS spread FROM rolled")(_rolled(_width))


@query(
    "count_candles",
    f"""WITH {BARS} SELECT instrument, (idx // 6)::BIGINT AS "group", min(time) AS time, round(first(open ORDER BY idx), 6) AS open, round(max(high), 6) AS high,
    round(min(low), 6) AS low, round(last(close ORDER BY idx), 6) AS close, sum(tick_count)::BIGINT AS tick_count FROM bars GROUP BY 1, 2 HAVING count(*) = 6""",
)
def count_candles(spark, sf_dir):
    return B.count_candles(bars(spark, sf_dir), 6).select("instrument", "group", "time", *rounded(*OHLC), "tick_count")


SWINGS = f"""{BARS}, flags AS (SELECT *,
      high >= max(high) OVER b AND high >= max(high) OVER a AND count(*) OVER b = 2 AND count(*) OVER a = 2 AS is_high,
      low <= min(low) OVER b AND low <= min(low) OVER a AND count(*) OVER b = 2 AND count(*) OVER a = 2 AS is_low
    FROM bars WINDOW b AS (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
  swings AS (SELECT instrument, time, idx, idx + 2 AS confirmed_idx, 'high' AS kind, high AS price FROM flags WHERE is_high
    UNION ALL SELECT instrument, time, idx, idx + 2, 'low', low FROM flags WHERE is_low)"""


@query("swings", f"WITH {SWINGS} SELECT instrument, time, idx, confirmed_idx, kind, round(price, 6) AS price FROM swings")
def swings(spark, sf_dir):
    return P.swings(bars(spark, sf_dir)).withColumn("price", F.round("price", 6))


BREAKS = f"""{SWINGS}, conf AS (SELECT *, lag(CASE WHEN is_high THEN high END, 2) OVER {W} AS ch, lag(CASE WHEN is_low THEN low END, 2) OVER {W} AS cl FROM flags),
  armed AS (SELECT *, count(ch) OVER c AS eh, count(cl) OVER c AS el, last_value(ch IGNORE NULLS) OVER c AS lh, last_value(cl IGNORE NULLS) OVER c AS ll
    FROM conf WINDOW c AS (PARTITION BY instrument ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  both_sides AS (SELECT instrument, eh AS epoch, min(idx) AS idx, min(lh) AS level, 0 AS rank, 'bullish' AS direction FROM armed WHERE eh > 0 AND high > lh GROUP BY 1, 2
    UNION ALL SELECT instrument, el, min(idx), min(ll), 1, 'bearish' FROM armed WHERE el > 0 AND low < ll GROUP BY 1, 2),
  breaks AS (SELECT s.instrument, b.time, s.idx, s.rank, s.direction, s.level,
      CASE WHEN coalesce(lag(direction) OVER (PARTITION BY s.instrument ORDER BY s.idx, rank), direction) = direction THEN 'BOS' ELSE 'CHOCH' END AS kind
    FROM both_sides s JOIN bars b ON b.instrument = s.instrument AND b.idx = s.idx)"""


@query("market_structure", f"WITH {BREAKS} SELECT instrument, time, idx, rank, direction, kind, round(level, 6) AS level FROM breaks")
def market_structure(spark, sf_dir):
    return P.structure_breaks(bars(spark, sf_dir)).withColumn("level", F.round("level", 6))


GAPS = f"""gaps AS (SELECT instrument, lag(time) OVER {W} AS time, idx - 1 AS idx, idx AS confirmed_idx, CASE WHEN low > lag(high, 2) OVER {W} THEN 'bullish' ELSE 'bearish' END AS kind,
      CASE WHEN low > lag(high, 2) OVER {W} THEN low ELSE lag(low, 2) OVER {W} END AS top, CASE WHEN low > lag(high, 2) OVER {W} THEN lag(high, 2) OVER {W} ELSE high END AS bottom
    FROM bars QUALIFY low > lag(high, 2) OVER {W} OR high < lag(low, 2) OVER {W})"""


@query("fvg", f"WITH {BARS}, {GAPS} SELECT instrument, time, idx, confirmed_idx, kind, round(top, 6) AS top, round(bottom, 6) AS bottom FROM gaps")
def fvg(spark, sf_dir):
    return P.gaps(bars(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("top", "bottom")})


TR = f"greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W}))"
ATR = f"tr AS (SELECT *, {TR} AS tr FROM bars), atr AS (SELECT *, CASE WHEN idx >= 13 THEN avg(tr) OVER {frame(14)} END AS atr, CASE WHEN idx >= 14 THEN avg(tr) OVER {frame(14)} END AS atr2 FROM tr)"


@query("atr_column", f"WITH {BARS}, {ATR} SELECT instrument, time, idx, round(tr, 6) AS tr, round(atr, 6) AS atr FROM atr")
def atr_column(spark, sf_dir):
    return P.with_atr(bars(spark, sf_dir)).select("instrument", "time", "idx", *rounded("tr", "atr"))


DISPLACED = """disp AS (SELECT instrument, time, idx, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS kind, abs(close - open) AS body, atr2 AS atr
    FROM atr WHERE abs(close - open) >= atr2 * 1.5 AND close <> open)"""


@query("displacement", f"WITH {BARS}, {ATR}, {DISPLACED} SELECT instrument, time, idx, idx AS confirmed_idx, kind, round(body, 6) AS body, round(atr, 6) AS atr FROM disp")
def displacement(spark, sf_dir):
    return P.displacements(bars(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("body", "atr")})


BLOCKS = f"""blocks AS (SELECT instrument, lag(time) OVER {W} AS time, idx - 1 AS idx, idx AS confirmed_idx, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS kind,
      lag(high) OVER {W} AS top, lag(low) OVER {W} AS bottom FROM atr
    QUALIFY abs(close - open) > atr2 * 2.0 AND sign(close - open) * sign(lag(close) OVER {W} - lag(open) OVER {W}) = -1)"""


@query("order_blocks", f"WITH {BARS}, {ATR}, {BLOCKS} SELECT instrument, time, idx, confirmed_idx, kind, round(top, 6) AS top, round(bottom, 6) AS bottom FROM blocks")
def order_blocks(spark, sf_dir):
    return P.order_blocks(bars(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("top", "bottom")})


POOL_LISTS = """lists AS (SELECT *, list(price) OVER (PARTITION BY instrument, kind ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS before FROM swings),
  pools AS (SELECT instrument, time, idx, confirmed_idx, kind, price, (1 + len(list_filter(coalesce(before, []), lambda p: abs(p - price) <= price * 2.0 / 100)))::BIGINT AS touches FROM lists)"""
POOLS = f"{SWINGS}, {POOL_LISTS}"


@query("liquidity", f"WITH {POOLS} SELECT instrument, time, idx, confirmed_idx, kind, round(price, 6) AS price, touches FROM pools WHERE touches >= 2")
def liquidity(spark, sf_dir):
    return P.liquidity(bars(spark, sf_dir), tolerance=2.0).withColumn("price", F.round("price", 6))


@query(
    "precompute_counts",
    f"""WITH {BREAKS}, {GAPS}, {ATR}, {DISPLACED}, {BLOCKS}, counts AS (SELECT instrument, 'swings' AS detector, count(*) AS n FROM swings GROUP BY 1
      UNION ALL SELECT instrument, 'gaps', count(*) FROM gaps GROUP BY 1 UNION ALL SELECT instrument, 'breaks', count(*) FROM breaks GROUP BY 1
      UNION ALL SELECT instrument, 'displacements', count(*) FROM disp GROUP BY 1 UNION ALL SELECT instrument, 'blocks', count(*) FROM blocks GROUP BY 1)
    SELECT c.instrument, detector, n, coalesce(arg_max(b.direction, b.idx * 2 + b.rank), 'undefined') AS trend FROM counts c LEFT JOIN breaks b ON b.instrument = c.instrument GROUP BY 1, 2, 3""",
)
def precompute_counts(spark, sf_dir):
    own = stored(P.armed(P.flagged(bars(spark, sf_dir))), "armed-bars")
    breaks = P.breaks_of(own)
    events = {"swings": P.swings_of(own), "gaps": P.gaps_of(own), "breaks": breaks, "displacements": P.displacements_of(own), "blocks": P.order_blocks_of(own)}
    counts = None
    for name, found in events.items():
        one = found.groupBy("instrument").agg(F.count("*").alias("n")).select("instrument", F.lit(name).alias("detector"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(P.final_trend(own, breaks), "instrument")


@query(
    "fvg_mitigation",
    f"""WITH {BARS}, {GAPS} SELECT g.instrument, g.idx, g.kind, round(g.top, 6) AS top, round(g.bottom, 6) AS bottom, min(b.idx) AS hit_idx FROM gaps g
    LEFT JOIN bars b ON b.instrument = g.instrument AND b.idx > g.confirmed_idx AND CASE WHEN g.kind = 'bullish' THEN b.low <= g.bottom ELSE b.high >= g.top END
    GROUP BY ALL""",
)
def fvg_mitigation(spark, sf_dir):
    own = bars(spark, sf_dir)
    found = P.gaps(own)
    return P.first_hit(found, own, *P.mitigation(found)).select("instrument", "idx", "kind", *rounded("top", "bottom"), "hit_idx")


@query(
    "liq_sweep",
    f"""WITH {POOLS} SELECT g.instrument, g.idx, g.kind, round(g.price, 6) AS price, min(b.idx) AS hit_idx FROM (SELECT * FROM pools WHERE touches >= 2) g
    LEFT JOIN bars b ON b.instrument = g.instrument AND b.idx > g.confirmed_idx AND b.low <= g.price AND g.price <= b.high GROUP BY ALL""",
)
def liq_sweep(spark, sf_dir):
    own = bars(spark, sf_dir)
    return P.first_hit(P.liquidity(own, tolerance=2.0), own, F.col("price"), F.col("price")).select("instrument", "idx", "kind", *rounded("price"), "hit_idx")


PREV = f"lag(close) OVER {W}"


@query(
    "observations",
    f"""WITH {BARS} SELECT instrument, time, {", ".join(f"round({c} / {PREV} - 1, 6) AS ret_{c}" for c in OHLC)}, tick_count, round(spread, 6) AS spread,
    round(sin(2 * pi() * (hour(time) + minute(time) / 60.0) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(time) + minute(time) / 60.0) / 24), 6) AS hour_cos,
    round(sin(2 * pi() * isodow(time) / 7), 6) AS dow_sin, round(cos(2 * pi() * isodow(time) / 7), 6) AS dow_cos FROM bars QUALIFY idx > 0""",
)
def observations(spark, sf_dir):
    from tickloom.operators.rolling import observation_columns

    own = observation_columns(bars(spark, sf_dir)).where("idx > 0")
    cyclic = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")
    return own.select("instrument", "time", *rounded(*[f"ret_{c}" for c in OHLC]), "tick_count", *rounded("spread", *cyclic))


@query(
    "rolling_vol_mom",
    f"""WITH {BARS}, r AS (SELECT *, close / {PREV} - 1 AS ret FROM bars) SELECT instrument, time, idx,
    {", ".join(f"round(coalesce(CASE WHEN idx >= {n} THEN stddev_samp(ret) OVER {frame(n)} END, 0), 6) AS vol_{n}, round(coalesce(CASE WHEN idx >= {n} THEN sum(ret) OVER {frame(n)} END, 0), 6) AS mom_{n}" for n in (5, 20, 60))}
    FROM r QUALIFY idx > 0""",
)
def rolling_vol_mom(spark, sf_dir):
    from tickloom.operators.rolling import volatility_momentum

    out = volatility_momentum(bars(spark, sf_dir)).where("idx > 0")
    return out.select("instrument", "time", "idx", *rounded(*[f"{k}_{n}" for n in (5, 20, 60) for k in ("vol", "mom")]))


@query(
    "scalp_features",
    f"""WITH {BARS} SELECT instrument, time, idx, round(CASE WHEN idx >= 5 THEN close / lag(close, 4) OVER {W} - 1 END, 6) AS roc_fast,
    round(CASE WHEN idx >= 12 THEN close / lag(close, 11) OVER {W} - 1 END, 6) AS roc_slow,
    round(CASE WHEN idx >= 19 THEN coalesce((close - avg(close) OVER {frame(20)}) / nullif(stddev_pop(close) OVER {frame(20)}, 0), 0) END, 6) AS mean_rev_z,
    round(CASE WHEN idx >= 13 THEN avg(high - low) OVER {frame(14)} END, 6) AS atr,
    round(CASE WHEN idx >= 13 THEN coalesce(sum(abs(close - open)) OVER {frame(14)} / nullif(sum(high - low) OVER {frame(14)}, 0), 0) END, 6) AS body_ratio FROM bars""",
)
def scalp_features(spark, sf_dir):
    from tickloom.operators.rolling import scalping

    out = scalping(bars(spark, sf_dir))
    return out.select("instrument", "time", "idx", *rounded("roc_fast", "roc_slow", "mean_rev_z", "atr", "body_ratio"))


STREAK = f"""dirs AS (SELECT *, CASE WHEN close >= open THEN 1 ELSE -1 END AS dir FROM bars),
  turns AS (SELECT *, CASE WHEN dir = lag(dir) OVER {W} THEN 0 ELSE 1 END AS turn FROM dirs),
  runs AS (SELECT *, sum(turn) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM turns)"""


@query(
    "direction_streak",
    f"WITH {BARS}, {STREAK} SELECT instrument, time, idx, (dir * least(row_number() OVER (PARTITION BY instrument, run ORDER BY idx), 21))::BIGINT AS streak FROM runs",
)
def direction_streak(spark, sf_dir):
    from tickloom.operators.rolling import streak

    signed = bars(spark, sf_dir).withColumn("dir", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    return streak(signed, "dir", 21).select("instrument", "time", "idx", "streak")


@query(
    "consecutive_run",
    f"""WITH {BARS}, d AS (SELECT *, coalesce(sign(close - {PREV}), 0)::INT AS dir FROM bars), t AS (SELECT *, CASE WHEN dir = lag(dir) OVER {W} THEN 0 ELSE 1 END AS turn FROM d),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM t)
    SELECT instrument, time, idx, (dir * least(row_number() OVER (PARTITION BY instrument, run ORDER BY idx), 1000))::BIGINT AS streak FROM r""",
)
def consecutive_run(spark, sf_dir):
    from tickloom.operators.rolling import streak

    own = bounded(bars(spark, sf_dir), lambda w: {"dir": F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)).cast("int")}, back=1)
    return streak(own, "dir", 1000).select("instrument", "time", "idx", "streak")


@query(
    "tick_features",
    f"""WITH {BARS} SELECT instrument, time, idx, round(spread, 6) AS spread,
    round(CASE WHEN idx >= 1 THEN coalesce((spread - avg(spread) OVER {frame(20)}) / nullif(round(stddev_pop(spread) OVER {frame(20)}, 9), 0), 0) ELSE 0 END, 6) AS spread_z,
    round(high - low, 6) AS bar_range, round(CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END, 6) AS position,
    round(lead(open) OVER {W}, 6) AS next_open FROM bars""",
)
def tick_features(spark, sf_dir):
    from tickloom.operators.rolling import spread_z

    own = bounded(
        bars(spark, sf_dir), lambda w: {"spread_z": spread_z(w, 20), "next_open": F.lead("open").over(w)}, back=19, ahead=1
    )
    span = F.col("high") - F.col("low")
    position = F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5)
    return own.withColumns({"bar_range": span, "position": position}).select(
        "instrument", "time", "idx", *rounded("spread", "spread_z", "bar_range", "position", "next_open")
    )


@query(
    "m1_indicators",
    f"""WITH {BARS}, d AS (SELECT *, close - {PREV} AS diff FROM bars) SELECT instrument, time, idx,
    round(CASE WHEN idx >= 14 THEN coalesce(100 * sum(greatest(diff, 0)) OVER {frame(14)} / nullif(sum(abs(diff)) OVER {frame(14)}, 0), 50) END, 5) AS rsi_sma,
    round(CASE WHEN idx >= 59 THEN (close - avg(close) OVER {frame(60)}) / nullif(stddev_samp(close) OVER {frame(60)}, 0) END, 6) AS z60,
    round(CASE WHEN idx >= 19 THEN (close - (avg(close) OVER {frame(20)} - 2 * stddev_pop(close) OVER {frame(20)})) / nullif(4 * stddev_pop(close) OVER {frame(20)}, 0) END, 6) AS pct_b,
    round(close / lag(close, 6) OVER {W} - 1, 6) AS roc6,
    round(CASE WHEN idx >= 29 THEN (avg(high - low) OVER {frame(6)}) / nullif(avg(high - low) OVER {frame(30)}, 0) END, 6) AS range_ratio,
    round(coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0), 6) AS upper_wick,
    round(coalesce((high - greatest(open, close) + least(open, close) - low) / nullif(high - low, 0), 0), 6) AS wicks, round(coalesce(abs(close - open) / nullif(high - low, 0), 0), 6) AS body,
    round(sin(2 * pi() * (hour(time) + minute(time) / 60.0) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(time) + minute(time) / 60.0) / 24), 6) AS hour_cos FROM d""",
)
def m1_indicators(spark, sf_dir):
    from tickloom.operators.rolling import indicators

    names = {"rsi_sma": 5, "z60": 6, "pct_b": 6, "roc6": 6, "range_ratio": 6, "upper_wick": 6, "wicks": 6, "body": 6, "hour_sin": 6, "hour_cos": 6}
    return indicators(bars(spark, sf_dir)).select("instrument", "time", "idx", *[F.round(c, p).alias(c) for c, p in names.items()])


def _rma(value: str, before: str, n: int, first: int) -> str:
    return f"CASE WHEN m.idx <= {first} THEN m.{value} ELSE {before} * ({n - 1}.0::DOUBLE / {n}) + m.{value} / {n} END AS {value}"


_MOVES = f"""mv AS (SELECT *, high - lag(high) OVER {W} AS u, lag(low) OVER {W} - low AS d, close - {PREV} AS diff, coalesce({TR}, high - low) AS tr FROM bars),
    m AS (SELECT instrument, time, idx, tr AS a14, tr AS a6, tr AS a30, greatest(diff, 0) AS gain, greatest(-diff, 0) AS loss, CASE WHEN u > d AND u > 0 THEN u WHEN u IS NOT NULL THEN 0 END AS plus,
      CASE WHEN d > u AND d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS minus FROM mv)"""
_CHAINS = {"a14": (14, 0), "a6": (6, 0), "a30": (30, 0), "gain": (14, 1), "loss": (14, 1), "plus": (14, 1), "minus": (14, 1)}


@query(
    "m1_rma",
    f"""WITH RECURSIVE {BARS}, {_MOVES}, e AS (SELECT instrument, time, idx, {", ".join(f"m.{c}::DOUBLE AS {c}" for c in _CHAINS)} FROM m WHERE idx = 0
      UNION ALL SELECT m.instrument, m.time, m.idx, {", ".join(_rma(c, f"e.{c}", n, first) for c, (n, first) in _CHAINS.items())} FROM e JOIN m ON m.instrument = e.instrument AND m.idx = e.idx + 1),
    x AS (SELECT *, CASE WHEN idx >= 1 THEN coalesce(100 * abs(plus - minus) / nullif(plus + minus, 0), 0) END AS dx FROM e),
    y AS (SELECT instrument, idx, dx AS adx FROM x WHERE idx = 1 UNION ALL SELECT x.instrument, x.idx, y.adx * (13.0::DOUBLE / 14) + x.dx / 14 FROM y JOIN x ON x.instrument = y.instrument AND x.idx = y.idx + 1)
    SELECT x.instrument, x.time, x.idx, round(a14, 6) AS atr_rma, round(a30, 6) AS atr30_rma, round(a6 / nullif(a30, 0), 6) AS atr_ratio, round(100 * gain / nullif(gain + loss, 0), 5) AS rsi_rma, round(adx, 5) AS adx
    FROM x LEFT JOIN y ON y.instrument = x.instrument AND y.idx = x.idx""",
)
def m1_rma(spark, sf_dir):
    from tickloom.operators.rolling import smoothed

    return smoothed(bars(spark, sf_dir)).select("instrument", "time", "idx", *rounded("atr_rma", "atr30_rma", "atr_ratio"), *rounded("rsi_rma", "adx", places=5))


@query(
    "future_direction",
    f"""WITH {BARS}, r AS (SELECT *, close / {PREV} - 1 AS ret FROM bars) SELECT instrument, time, idx,
    {", ".join(f"CASE WHEN count(ret) OVER (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN (round(sum(ret) OVER (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 9) > 0)::INT END AS up_{h}" for h in (1, 5, 10))} FROM r""",
)
def future_direction(spark, sf_dir):
    from tickloom.operators.rolling import future_up

    return future_up(bars(spark, sf_dir), (1, 5, 10)).select("instrument", "time", "idx", "up_1", "up_5", "up_10")


@query(
    "equity_curve",
    f"""WITH {BARS}, p AS (SELECT *, round(close - open, 2) AS pnl FROM bars), e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING) AS equity FROM p)
    SELECT instrument, idx, round(equity, 4) AS equity, round(greatest(10000, max(equity) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING)), 4) AS peak FROM e""",
)
def equity_curve(spark, sf_dir):
    own = bars(spark, sf_dir).withColumn("pnl", F.round(F.col("close") - F.col("open"), 2))
    summed = running(own, {"gain": ("sum", F.col("pnl"))}).withColumn("equity", F.col("gain") + 10000)
    peaked = running(summed, {"top": ("max", F.col("equity"))})
    return peaked.select("instrument", "idx", F.round("equity", 4).alias("equity"), F.round(F.greatest(F.lit(10000.0), "top"), 4).alias("peak"))


@query(
    "sample_every_n",
    f"WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time, seq) - 1 AS idx FROM ticks) SELECT instrument, time, seq, idx, round(mid, 6) AS mid FROM n WHERE idx % 10 = 9",
)
def sample_every_n(spark, sf_dir):
    numbered = with_index(ticks(spark, sf_dir), order=("time", "seq"), block="1 day")
    return numbered.where(F.col("idx") % 10 == 9).select("instrument", "time", "seq", "idx", *rounded("mid"))
