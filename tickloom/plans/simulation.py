"""Queries: position simulations, level features, model-ready sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market as M
from tickloom.operators import bars as B
from tickloom.operators import patterns as P
from tickloom.operators import sim
from tickloom.operators.asof import asof_join, range_join
from tickloom.operators.levels import level_features
from tickloom.operators.selection import one_at_a_time
from tickloom.operators.series import bounded, with_index
from tickloom.plans.base import BARS, bars, bars_sql, query, raw_bars, rounded, ticks
from tickloom.plans.patterns import ATR, BLOCKS, BREAKS, DISPLACED, GAPS, POOL_LISTS, W, frame
from tickloom.plans.joins import NEWS
from tickloom.plans.signals import CODES, ENTRIES, FACTORS, _entries, _scored, news_pause
from tickloom.sources.scratch import stored


def _rounded_trades(df):
    return df.select(
        "instrument", "run", "direction", "entry_idx", "exit_idx", "reason", *rounded("entry_price", "exit_price", "stop", "target", "size", "pnl", "r_multiple", "capital")
    )


@query("backtest_trades")
def backtest_trades(spark, sf_dir):
    own = _scored(spark, sf_dir).join(news_pause(spark, sf_dir), ["instrument", "time"])
    signal = F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1).otherwise(0)
    ready = own.select(
        "instrument", "idx", F.date_format("time", "yyyy-MM-dd").alias("day"), "high", "low", "close", "spread", "score", "paused", signal.alias("signal"), (1.5 * (F.col("high") - F.col("low"))).alias("stop_distance")
    )
    rules = {"base": sim.CandleRules(), "no_even": sim.CandleRules(even_at=9.0), "tight": sim.CandleRules(most_open=1, most_bars=12)}
    return _rounded_trades(sim.simulate(ready, sim.CandleRun, rules))


@query("tick_sim_trades")
def tick_sim_trades(spark, sf_dir):
    own = with_index(ticks(spark, sf_dir), order=("time", "seq"), block="1 day")
    seen = bounded(own, lambda w: {"before": F.lag("mid").over(w), "atr": F.avg(F.abs(F.col("mid") - F.lit(50.0))).over(w.rowsBetween(-13, 0))}, back=13)
    move = F.col("mid") - F.col("before")
    signal = F.when(F.col("seq") % 7 == 0, F.when(move > 0, 1).when(move < 0, -1).otherwise(0)).otherwise(0)
    ready = seen.select("instrument", "idx", "bid", "ask", "atr", F.coalesce(signal, F.lit(0)).alias("signal"), (F.col("seq") % 10 / 10.0).alias("confidence"))
    rules = {"fixed": sim.TickRules(), "ramp": sim.TickRules(gamma=2.0, least_risk=0.005), "ranged": sim.TickRules(k_stop=1.0, k_target=1.5, most_open=3)}
    return _rounded_trades(sim.simulate(ready, sim.TickRun, rules))


@query("bar_sim_trades")
def bar_sim_trades(spark, sf_dir):
    own = bounded(bars(spark, sf_dir), lambda w: {"next_open": F.lead("open").over(w), "next_spread": F.lead("spread").over(w), "roc": F.col("close") - F.lag("close", 3).over(w)}, back=3, ahead=1)
    signal = F.coalesce(F.when(F.col("roc") > 0, 1).when(F.col("roc") < 0, -1), F.lit(0))
    ready = own.select("instrument", "idx", "high", "low", "next_open", "next_spread", signal.alias("signal"), (F.col("tick_count") % 4 / 4.0).alias("confidence"))
    rules = {"with": sim.BarRules(), "against": sim.BarRules(threshold=-0.5)}
    return _rounded_trades(sim.simulate(ready, sim.BarRun, rules))


@query(
    "env_rollout",
    f"""WITH RECURSIVE {BARS}, r AS (SELECT instrument, idx // 16 AS path, idx % 16 AS step, (idx % 3 - 1)::INT AS action, round(coalesce(close / lag(close) OVER {W} - 1, 0), 6) AS ret FROM bars),
    e AS (SELECT instrument, path, step, action, 1 + (action * ret - abs(action) * 0.001 - CASE WHEN action = 0 THEN 0.0001 ELSE 0 END) AS value, action * ret - abs(action) * 0.001 - CASE WHEN action = 0 THEN 0.0001 ELSE 0 END AS reward FROM r WHERE step = 0
      UNION ALL SELECT r.instrument, r.path, r.step, r.action, e.value * (1 + (r.action * r.ret - abs(r.action - e.action) * 0.001 - CASE WHEN r.action = 0 THEN 0.0001 ELSE 0 END)), e.reward + (r.action * r.ret - abs(r.action - e.action) * 0.001 - CASE WHEN r.action = 0 THEN 0.0001 ELSE 0 END)
      FROM e JOIN r ON r.instrument = e.instrument AND r.path = e.path AND r.step = e.step + 1)
    SELECT instrument, path::BIGINT AS path, round(last(value ORDER BY step), 4) AS value, round(last(reward ORDER BY step), 4) AS reward FROM e GROUP BY 1, 2""",
)
def env_rollout(spark, sf_dir):
    from tickloom.operators.rolling import returns

    own = returns(bars(spark, sf_dir)).select(
        "instrument",
        F.floor(F.col("idx") / 16).alias("path"),
        (F.col("idx") % 16).alias("step"),
        (F.col("idx") % 3 - 1).cast("int").alias("action"),
        F.round(F.coalesce("ret", F.lit(0.0)), 6).alias("ret"),
    )
    return sim.rollout(own, ["instrument", "path"], 0.001, 0.0001).select("instrument", "path", *rounded("value", "reward", places=4))


#: Each entry with its exit at a stop, a target or after 24 bars.
FIXED_EXITS = f"""{BREAKS}, {FACTORS}, {ENTRIES}, s AS (SELECT instrument, idx, direction, close AS entry, 1.5 * span AS d FROM e),
    h AS (SELECT s.instrument, s.idx, min(CASE WHEN (direction = 'bullish' AND b.low <= entry - d) OR (direction = 'bearish' AND b.high >= entry + d) THEN b.idx END) AS stop_idx,
        min(CASE WHEN (direction = 'bullish' AND b.high >= entry + 2 * d) OR (direction = 'bearish' AND b.low <= entry - 2 * d) THEN b.idx END) AS target_idx, max(b.idx) AS last_idx, last(b.close ORDER BY b.idx) AS last_close
      FROM s JOIN bars b ON b.instrument = s.instrument AND b.idx BETWEEN s.idx + 1 AND s.idx + 24 GROUP BY 1, 2),
    x AS (SELECT s.instrument, s.idx, s.direction, CASE WHEN stop_idx IS NOT NULL AND (target_idx IS NULL OR stop_idx <= target_idx) THEN 'stop' WHEN target_idx IS NOT NULL THEN 'target' ELSE 'time' END AS reason,
      CASE WHEN stop_idx IS NOT NULL AND (target_idx IS NULL OR stop_idx <= target_idx) THEN stop_idx WHEN target_idx IS NOT NULL THEN target_idx ELSE last_idx END AS exit_idx,
      round(CASE WHEN stop_idx IS NOT NULL AND (target_idx IS NULL OR stop_idx <= target_idx) THEN -d WHEN target_idx IS NOT NULL THEN 2 * d WHEN direction = 'bullish' THEN last_close - entry ELSE entry - last_close END, 6) AS points
    FROM s JOIN h USING (instrument, idx))"""


def _fixed_exits(spark, sf_dir):
    entries = _entries(spark, sf_dir).select("instrument", "time", "idx", "direction", F.col("close").alias("entry"), (1.5 * F.col("span")).alias("d"))
    path = bars(spark, sf_dir).select("instrument", F.col("idx").alias("j"), "high", "low", "close")
    met = range_join(entries, path, ["instrument"], "j", F.col("idx") + 1, F.col("idx") + 24, 24)
    up, entry, d = F.col("direction") == "bullish", F.col("entry"), F.col("d")
    stopped = F.when(up, F.col("low") <= entry - d).otherwise(F.col("high") >= entry + d)
    reached = F.when(up, F.col("high") >= entry + 2 * d).otherwise(F.col("low") <= entry - 2 * d)
    ends = met.groupBy("instrument", "time", "idx", "direction", "entry", "d").agg(
        F.min(F.when(stopped, F.col("j"))).alias("s"), F.min(F.when(reached, F.col("j"))).alias("g"), F.max("j").alias("last_idx"), F.max_by("close", "j").alias("last_close")
    )
    lost = F.col("s").isNotNull() & (F.col("g").isNull() | (F.col("s") <= F.col("g")))
    won = F.col("g").isNotNull()
    drift = F.when(up, F.col("last_close") - entry).otherwise(entry - F.col("last_close"))
    return ends.select(
        "instrument",
        "time",
        "idx",
        "direction",
        F.when(lost, "stop").when(won, "target").otherwise("time").alias("reason"),
        F.when(lost, F.col("s")).when(won, F.col("g")).otherwise(F.col("last_idx")).alias("exit_idx"),
        F.round(F.when(lost, -d).when(won, 2 * d).otherwise(drift), 6).alias("points"),
    )


@query("backtest_fixed_exit", f"WITH {FIXED_EXITS} SELECT * FROM x")
def backtest_fixed_exit(spark, sf_dir):
    return _fixed_exits(spark, sf_dir).drop("time")


@query(
    "news_runs",
    f"""WITH RECURSIVE {FIXED_EXITS}, {NEWS}, p AS (SELECT currency, time AS begins, time + INTERVAL '3 hours' AS ends FROM news WHERE {CODES} = 'pause'),
    paused AS (SELECT b.instrument, b.idx FROM bars b WHERE EXISTS (SELECT 1 FROM p WHERE p.currency = b.instrument AND b.time >= p.begins AND b.time < p.ends)),
    arms AS MATERIALIZED (SELECT 'without' AS arm, instrument, idx, exit_idx, points FROM x UNION ALL SELECT 'with', instrument, idx, exit_idx, points FROM x ANTI JOIN paused USING (instrument, idx)),
    n AS MATERIALIZED (SELECT a.arm, a.instrument, a.idx, b.idx AS follows FROM arms a ASOF JOIN arms b ON a.arm = b.arm AND a.instrument = b.instrument AND a.exit_idx <= b.idx),
    taken AS (SELECT arm, instrument, min(idx) AS idx FROM arms GROUP BY ALL UNION ALL SELECT n.arm, n.instrument, n.follows FROM taken t JOIN n ON n.arm = t.arm AND n.instrument = t.instrument AND n.idx = t.idx)
    SELECT arm, instrument, count(*) AS n_trades, round(sum(points), 4) AS points, round(count(*) FILTER (points > 0) / count(*)::DOUBLE, 6) AS win_rate FROM arms JOIN taken USING (arm, instrument, idx) GROUP BY ALL""",
)
def news_runs(spark, sf_dir):
    """The entries run twice with one position: as they are, and with those refused that fall into a pause for news.

    An entry that is refused leaves room for later ones, so neither run is a part of the other.
    """
    own = stored(_fixed_exits(spark, sf_dir), "exits")
    calm = news_pause(spark, sf_dir).where("NOT paused").select("instrument", "time")
    arms = own.withColumn("arm", F.lit("without")).unionByName(own.join(calm, ["instrument", "time"], "left_semi").withColumn("arm", F.lit("with")))
    taken = one_at_a_time(arms.select("arm", "instrument", "idx", F.col("exit_idx"), "points"), ("arm", "instrument"))
    won = F.count(F.when(F.col("points") > 0, 1)) / F.count("*")
    return taken.groupBy("arm", "instrument").agg(F.count("*").alias("n_trades"), F.round(F.sum("points"), 4).alias("points"), F.round(won, 6).alias("win_rate"))


AGE, LOOKBACK, TOLERANCE = 100, 20, 2.0
ICT = ("fvg_distance", "fvg_direction", "ob_distance", "ob_direction", "liq_distance", "bos_recent", "choch_recent", "trend", "displacement_recent", "premium_discount")


def _ict_sql(width: str, sized: str | None = None, view: str | None = None) -> str:
    """Features of one timeframe at each row of px; by default at the close of each hourly bar."""
    break_sql, sized = BREAKS, sized or bars_sql("bars", width)
    view = view or f"px p ASOF LEFT JOIN st ON st.instrument = p.instrument AND p.time + INTERVAL '1 hour' >= st.time + INTERVAL '{width}'"
    nearest = "first({what} ORDER BY round(abs(price - middle), 6), level_idx) FILTER (sort = '{sort}')"

    def near(what, sort):
        return nearest.format(what=what, sort=sort)

    return f"""(WITH {break_sql.replace(bars_sql('bars', '1 hour'), sized)}, {GAPS}, {ATR}, {DISPLACED}, {BLOCKS}, {POOL_LISTS},
      lv AS (SELECT g.instrument, 'gap' AS sort, (g.top + g.bottom) / 2 AS middle, CASE WHEN g.kind = 'bullish' THEN 1.0::DOUBLE ELSE -1.0 END AS direction, g.idx AS level_idx, g.confirmed_idx AS begins,
          (SELECT min(b.idx) FROM bars b WHERE b.instrument = g.instrument AND b.idx > g.confirmed_idx AND CASE WHEN g.kind = 'bullish' THEN b.low <= g.bottom ELSE b.high >= g.top END) AS hit FROM gaps g
        UNION ALL SELECT instrument, 'block', (top + bottom) / 2, CASE WHEN kind = 'bullish' THEN 1.0::DOUBLE ELSE -1.0 END, idx, confirmed_idx, NULL FROM blocks
        UNION ALL SELECT p.instrument, 'pool', p.price, 0.0, p.idx, p.confirmed_idx, (SELECT min(b.idx) FROM bars b WHERE b.instrument = p.instrument AND b.idx >= p.confirmed_idx AND b.low <= p.price AND b.high >= p.price) FROM pools p WHERE touches >= 2),
      alive AS (SELECT *, least(coalesce(hit, 1000000000), level_idx + {AGE + 1}) AS ends FROM lv),
      st AS (SELECT b.instrument, b.idx, b.time, avg(b.high - b.low) OVER {frame(14)} AS span,
          (SELECT arg_max(price, confirmed_idx) FROM swings s WHERE s.instrument = b.instrument AND s.kind = 'high' AND s.confirmed_idx <= b.idx) AS hi,
          (SELECT arg_max(price, confirmed_idx) FROM swings s WHERE s.instrument = b.instrument AND s.kind = 'low' AND s.confirmed_idx <= b.idx) AS lo,
          (SELECT arg_max(direction, k.idx * 2 + k.rank) FROM breaks k WHERE k.instrument = b.instrument AND k.idx <= b.idx) AS trend,
          EXISTS (SELECT 1 FROM breaks k WHERE k.instrument = b.instrument AND k.kind = 'BOS' AND k.idx BETWEEN b.idx - {LOOKBACK} AND b.idx) AS bos,
          EXISTS (SELECT 1 FROM breaks k WHERE k.instrument = b.instrument AND k.kind = 'CHOCH' AND k.idx BETWEEN b.idx - {LOOKBACK} AND b.idx) AS choch,
          EXISTS (SELECT 1 FROM disp d WHERE d.instrument = b.instrument AND d.idx BETWEEN b.idx - {LOOKBACK} AND b.idx) AS moved FROM bars b),
      vw AS (SELECT p.instrument, p.time, p.price, st.* EXCLUDE (instrument, time) FROM {view}),
      nr AS (SELECT v.instrument, v.time, {near('abs(price - middle)', 'gap')} AS fd, {near('direction', 'gap')} AS fdir, {near('abs(price - middle)', 'block')} AS od, {near('direction', 'block')} AS odir, {near('abs(price - middle)', 'pool')} AS ld
        FROM vw v JOIN alive l ON l.instrument = v.instrument AND v.idx >= l.begins AND v.idx < l.ends GROUP BY 1, 2)
      SELECT v.instrument, v.time, coalesce(fd / coalesce(nullif(span, 0), 1), 0) AS fvg_distance, coalesce(fdir, 0) AS fvg_direction, coalesce(od / coalesce(nullif(span, 0), 1), 0) AS ob_distance, coalesce(odir, 0) AS ob_direction,
        coalesce(ld / coalesce(nullif(span, 0), 1), 0) AS liq_distance, coalesce(bos, false)::INT::DOUBLE AS bos_recent, coalesce(choch, false)::INT::DOUBLE AS choch_recent,
        CASE trend WHEN 'bullish' THEN 1.0::DOUBLE WHEN 'bearish' THEN -1.0 ELSE 0.0 END AS trend, coalesce(moved, false)::INT::DOUBLE AS displacement_recent,
        CASE WHEN price > lo + (hi - lo) * 0.5 THEN 1.0::DOUBLE WHEN price < lo + (hi - lo) * 0.5 THEN -1.0 ELSE 0.0 END AS premium_discount FROM vw v LEFT JOIN nr ON nr.instrument = v.instrument AND nr.time = v.time)"""


@query(
    "ict_features",
    f"""WITH {BARS}, px AS (SELECT instrument, time, close AS price FROM bars), small AS {_ict_sql('1 hour')}, large AS {_ict_sql('4 hours')}
    SELECT px.instrument, px.time, {", ".join(f"round({t}.{c}, 6) AS {t}_{c}" for t in ("small", "large") for c in ICT)}, (hour(px.time) < 4 OR hour(px.time) BETWEEN 7 AND 9 OR hour(px.time) BETWEEN 12 AND 15)::INT::DOUBLE AS killzone
    FROM px JOIN small ON small.instrument = px.instrument AND small.time = px.time JOIN large ON large.instrument = px.instrument AND large.time = px.time""",
)
def ict_features(spark, sf_dir):
    """Levels and structure of the hourly bars and of the last closed 4-hour bar, at each hourly close."""
    own = stored(bars(spark, sf_dir), "bars")
    prices = own.select("instrument", "time", F.col("close").alias("price"))
    out = prices.select("instrument", "time", (M.killzone(F.hour("time")) != "none").cast("double").alias("killzone"))
    wide = stored(with_index(B.roll_up(own.drop("idx"), "4 hours")), "wide-bars")
    closed = wide.select("instrument", F.col("time") + F.expr("INTERVAL 4 HOURS") - F.expr("INTERVAL 1 HOUR"), F.col("idx").alias("at_idx")).toDF("instrument", "time", "at_idx")
    views = {"small": own.select("instrument", "time", F.col("close").alias("price"), F.col("idx").alias("at_idx")), "large": asof_join(prices, closed, ["instrument"], ["at_idx"])}
    for name, frame_bars in (("small", own), ("large", wide)):
        found = level_features(views[name], frame_bars, AGE, LOOKBACK, TOLERANCE)
        out = out.join(found.select("instrument", "time", *[F.round(c, 6).alias(f"{name}_{c}") for c in ICT]), ["instrument", "time"])
    return out


def _events_sql(width: str) -> str:
    found = {"swing": "kind, idx FROM swings", "gap": "kind, idx FROM gaps", "block": "kind, idx FROM blocks", "displacement": "kind, idx FROM disp", "pool": "kind, idx FROM pools WHERE touches >= 2", "break": "direction || ' ' || kind, idx FROM breaks"}
    sized = BREAKS.replace(bars_sql("bars", "1 hour"), bars_sql("bars", width))
    parts = [f"SELECT instrument, '{width}' AS timeframe, '{name}' AS detector, {what}" for name, what in found.items()]
    return f"(WITH {sized}, {GAPS}, {ATR}, {DISPLACED}, {BLOCKS}, {POOL_LISTS} {' UNION ALL '.join(parts)})"


WIDTHS = ("1 hour", "4 hours", "1 day")


@query("events_by_timeframe", " UNION ALL ".join(f"SELECT * FROM {_events_sql(w)} t(instrument, timeframe, detector, kind, idx)" for w in WIDTHS))
def events_by_timeframe(spark, sf_dir):
    """Every event of every detector on three timeframes."""
    own = stored(raw_bars(spark, sf_dir), "bars")
    frames = {w: with_index(own if w == "1 hour" else B.roll_up(own, w)) for w in WIDTHS}
    return P.all_events(frames, TOLERANCE).select("instrument", "timeframe", "detector", "kind", "idx")
