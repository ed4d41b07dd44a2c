"""Queries: scans and stores, scalar rules, signals, news, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market as M
from tickloom.functions import news as N
from tickloom.operators import bars as B
from tickloom.operators import patterns as P
from tickloom.operators import stats as S
from tickloom.operators import windows as V
from tickloom.operators.series import bounded
from tickloom.plans.base import BARS, TICKS, TRADES, bars, bars_sql, query, raw_bars, rounded, table, ticks, trades
from tickloom.plans.joins import HTF_TREND_SQL, NEWS, news, trend_of_wide_bars
from tickloom.plans.patterns import ATR, BLOCKS, BREAKS, DISPLACED, GAPS, W, frame
from tickloom.sources.scratch import stored

FROM, TO = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
BETWEEN = f"time >= TIMESTAMP '{FROM}' AND time < TIMESTAMP '{TO}'"


def _between(column="time"):
    return (F.col(column) >= F.to_timestamp_ntz(F.lit(FROM))) & (F.col(column) < F.to_timestamp_ntz(F.lit(TO)))


@query("parquet_dir_scan", "SELECT event_id, ts, user_id, value FROM events")
def parquet_dir_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").try_cast("long").alias("user_id"), "value")


@query("tick_range_scan", f"WITH {TICKS} SELECT time, seq, bid, ask FROM ticks WHERE instrument = 'view' AND {BETWEEN}")
def tick_range_scan(spark, sf_dir):
    return ticks(spark, sf_dir).where((F.col("instrument") == "view") & _between()).select("time", "seq", "bid", "ask")


@query("candle_range_scan", f"WITH {BARS} SELECT instrument, time, round(close, 6) AS close FROM bars WHERE {BETWEEN} ORDER BY time, instrument LIMIT 100")
def candle_range_scan(spark, sf_dir):
    return B.candles(ticks(spark, sf_dir).where(_between()), "1 hour").orderBy("time", "instrument").limit(100).select("instrument", "time", *rounded("close"))


@query("window_filter", f"WITH {TRADES} SELECT trade_id, opened_at, pnl FROM trades WHERE opened_at >= TIMESTAMP '1995-01-01' AND opened_at < TIMESTAMP '1995-07-01'")
def window_filter(spark, sf_dir):
    begin, end = (F.to_timestamp_ntz(F.lit(x)) for x in ("1995-01-01", "1995-07-01"))
    return trades(spark, sf_dir).where((F.col("opened_at") >= begin) & (F.col("opened_at") < end)).select("trade_id", "opened_at", "pnl")


LOADED = f"{BARS}, loaded AS (SELECT instrument, time, close + 1 AS close FROM bars WHERE hour(time) < 6 UNION ALL SELECT instrument, time - INTERVAL '1 year', close FROM bars WHERE hour(time) = 23)"


def _stored_loaded(spark, sf_dir):
    stored = raw_bars(spark, sf_dir).select("instrument", "time", "close")
    early = stored.where(F.hour("time") < 6).withColumn("close", F.col("close") + 1)
    older = stored.where(F.hour("time") == 23).withColumn("time", F.col("time") - F.expr("INTERVAL 1 YEAR"))
    return stored, early.unionByName(older)


MERGED = "(SELECT instrument, time, close, 1 AS s FROM {0} UNION ALL SELECT instrument, time, close, 2 FROM {1})"


@query("candle_upsert", f"WITH {LOADED} SELECT instrument, time, round(arg_min(close, s), 6) AS close FROM {MERGED.format('loaded', 'bars')} GROUP BY 1, 2")
def candle_upsert(spark, sf_dir):
    stored, loaded = _stored_loaded(spark, sf_dir)
    return B.upsert(stored, loaded, ["instrument", "time"]).withColumn("close", F.round("close", 6))


@query("distinct_on_prefer", f"WITH {LOADED} SELECT instrument, time, round(arg_min(close, s), 6) AS close FROM {MERGED.format('bars', 'loaded')} GROUP BY 1, 2")
def distinct_on_prefer(spark, sf_dir):
    stored, loaded = _stored_loaded(spark, sf_dir)
    return B.merge_sources(stored, loaded, ["instrument", "time"]).withColumn("close", F.round("close", 6))


@query("candles_merged", f"WITH {LOADED} SELECT instrument, time, round(close, 6) AS close FROM bars UNION ALL SELECT instrument, time, round(close, 6) FROM loaded")
def candles_merged(spark, sf_dir):
    stored, loaded = _stored_loaded(spark, sf_dir)
    return stored.unionByName(loaded).withColumn("close", F.round("close", 6))


@query("insert_ignore", f"WITH {NEWS}, more AS (SELECT id + 25 * (id % 3) AS id, k + 1 AS k FROM news) SELECT id, k FROM news UNION ALL SELECT id, min(k) FROM more WHERE id NOT IN (SELECT id FROM news) GROUP BY 1")
def insert_ignore(spark, sf_dir):
    stored = news(spark, sf_dir).select("id", "k")
    loaded = stored.select((F.col("id") + 25 * (F.col("id") % 3)).alias("id"), (F.col("k") + 1).alias("k"))
    return B.insert_ignore(stored, loaded, ["id"], "k")


@query("day_completeness", f"WITH {TICKS} SELECT instrument, strftime(time, '%Y-%m-%d') AS day, count(*) AS n, count(*) > 5 AS complete FROM ticks GROUP BY 1, 2")
def day_completeness(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("instrument", F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).withColumn("complete", F.col("n") > 5)


@query("latest_candle_time", f"WITH {LOADED} SELECT instrument, max(time) + INTERVAL '1 hour' AS resume_at FROM (SELECT instrument, time FROM bars UNION ALL SELECT instrument, time FROM loaded) GROUP BY 1")
def latest_candle_time(spark, sf_dir):
    stored, loaded = _stored_loaded(spark, sf_dir)
    latest = stored.unionByName(loaded).groupBy("instrument").agg(F.max("time").alias("last"))
    return latest.select("instrument", (F.col("last") + F.expr("INTERVAL 1 HOUR")).alias("resume_at"))


@query("candle_count", f"WITH {BARS} SELECT instrument, count(*) AS n FROM bars GROUP BY 1")
def candle_count(spark, sf_dir):
    return raw_bars(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"))


@query("month_partition", f"WITH {TRADES} SELECT strftime(opened_at, '%Y-%m') AS month, count(*) AS n, min(opened_at) AS first_at FROM trades GROUP BY 1")
def month_partition(spark, sf_dir):
    return trades(spark, sf_dir).groupBy(F.date_format("opened_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("opened_at").alias("first_at"))


@query(
    "parse_currency_value",
    r"""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'EUR1,' || (100 + o_orderkey % 900) || '.50' WHEN 1 THEN '$' || o_orderkey WHEN 2 THEN 'n/a' ELSE '-' || (o_orderkey % 7) || '.25 USD' END AS text FROM orders)
    SELECT id, try_cast(replace(regexp_extract(text, '(-?[0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS value FROM t""",
)
def parse_currency_value(spark, sf_dir):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("EUR1,"), 100 + key % 900, F.lit(".50")))
        .when(key % 4 == 1, F.concat(F.lit("$"), key))
        .when(key % 4 == 2, "n/a")
        .otherwise(F.concat(F.lit("-"), key % 7, F.lit(".25 USD")))
    )
    return table(spark, sf_dir, "orders").select(key.alias("id"), M.currency_value(text).alias("value"))


@query("tick_mid_spread", f"WITH {TICKS} SELECT instrument, seq, round((bid + ask) / 2, 6) AS mid, round(ask - bid, 6) AS spread FROM ticks")
def tick_mid_spread(spark, sf_dir):
    return B.tick_columns(ticks(spark, sf_dir).drop("mid")).select("instrument", "seq", *rounded("mid", "spread"))


@query("candle_range_pos", f"WITH {BARS} SELECT instrument, time, round(high - low, 6) AS bar_range, round(CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END, 6) AS position FROM bars")
def candle_range_pos(spark, sf_dir):
    own = raw_bars(spark, sf_dir)
    position = M.position_in_range(F.col("close"), F.col("low"), F.col("high"))
    return own.select("instrument", "time", F.round(F.col("high") - F.col("low"), 6).alias("bar_range"), F.round(position, 6).alias("position"))


@query(
    "sessions",
    f"""WITH {BARS}, h AS (SELECT instrument, time, hour(time) AS h FROM bars) SELECT instrument, time, CASE WHEN h < 7 THEN 'asian' WHEN h < 12 THEN 'london' WHEN h < 21 THEN 'new_york' ELSE 'off_hours' END AS session,
    CASE WHEN h < 4 THEN 'asian_open' WHEN h >= 7 AND h < 10 THEN 'london_open' WHEN h >= 12 AND h < 15 THEN 'new_york_open' WHEN h = 15 THEN 'london_close' ELSE 'none' END AS killzone,
    h < 4 OR (h >= 7 AND h < 10) OR (h >= 12 AND h < 16) AS in_killzone FROM h""",
)
def sessions(spark, sf_dir):
    hour = F.hour("time")
    out = raw_bars(spark, sf_dir).select("instrument", "time", M.session(hour).alias("session"), M.killzone(hour).alias("killzone"))
    return out.withColumn("in_killzone", F.col("killzone") != "none")


RANGE = f"rng AS (SELECT *, max(high) OVER {frame(20)} AS hi, min(low) OVER {frame(20)} AS lo FROM bars)"


def _ranged(spark, sf_dir):
    return bounded(bars(spark, sf_dir), lambda w: {"hi": F.max("high").over(w.rowsBetween(-19, 0)), "lo": F.min("low").over(w.rowsBetween(-19, 0))}, back=19)


@query(
    "premium_discount",
    f"""WITH {BARS}, {RANGE} SELECT instrument, idx, round(lo + (hi - lo) * 0.5, 6) AS middle, round(lo + (hi - lo) * 0.62, 6) AS entry_low, round(lo + (hi - lo) * 0.79, 6) AS entry_high,
    CASE WHEN close > lo + (hi - lo) * 0.5 THEN 'premium' WHEN close < lo + (hi - lo) * 0.5 THEN 'discount' ELSE 'equilibrium' END AS zone FROM rng""",
)
def premium_discount(spark, sf_dir):
    lo, hi = F.col("lo"), F.col("hi")
    levels = {"middle": 0.5, "entry_low": 0.62, "entry_high": 0.79}
    return _ranged(spark, sf_dir).select(
        "instrument", "idx", *[F.round(M.level(lo, hi, s), 6).alias(n) for n, s in levels.items()], M.price_zone(F.col("close"), lo, hi).alias("zone")
    )


@query("ote_zone", f"WITH {BARS}, {RANGE} SELECT instrument, idx, close BETWEEN lo + (hi - lo) * 0.62 AND lo + (hi - lo) * 0.79 AS in_zone FROM rng")
def ote_zone(spark, sf_dir):
    return _ranged(spark, sf_dir).select("instrument", "idx", M.in_entry_zone(F.col("close"), F.col("lo"), F.col("hi")).alias("in_zone"))


@query("trade_filter", f"WITH {BARS} SELECT instrument, idx, spread <= 5 AND hour(time) IN (0, 1, 2, 3, 7, 8, 9, 12, 13, 14, 15) AS allowed FROM bars")
def trade_filter(spark, sf_dir):
    allowed = (F.col("spread") <= 5) & (M.killzone(F.hour("time")) != "none")
    return bars(spark, sf_dir).select("instrument", "idx", allowed.alias("allowed"))


#: The factors known at a bar's close, as SQL: events at that bar, a break in the last ten, zone of the last swings, trend of the 4-hour bars.
FACTORS = f"""{GAPS}, {ATR}, {DISPLACED}, {BLOCKS}, f AS (SELECT b.*, a.atr,
      EXISTS (SELECT 1 FROM breaks k WHERE k.instrument = b.instrument AND k.idx BETWEEN b.idx - 9 AND b.idx) AS has_break,
      EXISTS (SELECT 1 FROM gaps g WHERE g.instrument = b.instrument AND g.confirmed_idx = b.idx) AS has_gap,
      EXISTS (SELECT 1 FROM blocks o WHERE o.instrument = b.instrument AND o.confirmed_idx = b.idx) AS has_block,
      EXISTS (SELECT 1 FROM disp d WHERE d.instrument = b.instrument AND d.idx = b.idx) AS has_displacement,
      (SELECT arg_max(k.direction, k.idx * 2 + k.rank) FROM breaks k WHERE k.instrument = b.instrument AND k.idx BETWEEN b.idx - 9 AND b.idx) AS direction,
      (SELECT arg_max(price, confirmed_idx) FROM swings s WHERE s.instrument = b.instrument AND s.kind = 'high' AND s.confirmed_idx <= b.idx) AS hi,
      (SELECT arg_max(price, confirmed_idx) FROM swings s WHERE s.instrument = b.instrument AND s.kind = 'low' AND s.confirmed_idx <= b.idx) AS lo
    FROM bars b JOIN atr a ON a.instrument = b.instrument AND a.idx = b.idx)"""
SCORE = """least(1.0::DOUBLE, CASE WHEN has_gap THEN 0.15 ELSE 0 END + CASE WHEN has_block THEN 0.20 ELSE 0 END + CASE WHEN has_break THEN 0.25 ELSE 0 END + CASE WHEN has_displacement THEN 0.10 ELSE 0 END
    + CASE WHEN hour(time) IN (0, 1, 2, 3, 7, 8, 9, 12, 13, 14, 15) THEN 0.15 ELSE 0 END + CASE WHEN hi IS NOT NULL AND lo IS NOT NULL AND close <> lo + (hi - lo) * 0.5 THEN 0.15 ELSE 0 END)"""
#: Trend of the last closed 4-hour bar at each bar, and entries: a score of 0.4, the last break's direction, not against that trend.
ENTRIES = f"""big AS ({HTF_TREND_SQL}), e AS (SELECT f.*, coalesce(atr, high - low) AS span FROM f JOIN big USING (instrument, time)
    WHERE direction IS NOT NULL AND round({SCORE}, 9) >= 0.4 AND big.htf_trend IN ('undefined', direction) AND coalesce(atr, high - low) > 0)"""
WEIGHTS = {"gap": 0.15, "block": 0.20, "break": 0.25, "displacement": 0.10, "killzone": 0.15, "zone": 0.15}


def _scored(spark, sf_dir):
    """Bars with the factors known at their close and their confluence score."""
    return _with_score(stored(P.armed(P.flagged(bars(spark, sf_dir))), "armed-bars"))


def _with_score(own):
    event = F.struct("idx", "rank", "direction")
    breaks = P.breaks_of(own).groupBy("instrument", "idx").agg(F.array_sort(F.collect_list(event)).alias("found"))
    joined = own.join(breaks, ["instrument", "idx"], "left")
    recent = bounded(joined, lambda w: {"recent": F.flatten(F.collect_list("found").over(w.rowsBetween(-9, 0)))}, back=9)
    zone = M.price_zone(F.col("close"), F.col("lo"), F.col("hi"))
    present = {
        **P.confirmed_here(),
        "break": F.size("recent") > 0,
        "killzone": M.killzone(F.hour("time")) != "none",
        "zone": F.coalesce(F.col("hi").isNotNull() & F.col("lo").isNotNull() & zone.isin("premium", "discount"), F.lit(False)),
    }
    score = M.confluence(WEIGHTS, {n: present[n] for n in WEIGHTS})
    return recent.withColumns({"score": score, "direction": F.try_element_at("recent", F.lit(-1))["direction"]})


def _entries(spark, sf_dir, least=0.4):
    """Bars that give an entry: score, direction of the last break, not against the trend of the 4-hour bars; ``span`` is their range."""
    own = stored(P.armed(P.flagged(bars(spark, sf_dir))), "armed-bars")
    hit = _with_score(own).where(F.col("direction").isNotNull() & (F.round("score", 9) >= least))
    span = F.coalesce("atr", F.col("high") - F.col("low"))
    trend = trend_of_wide_bars(own.select("instrument", "time", "open", "high", "low", "close", "tick_count", "spread"))
    with_trend = hit.withColumn("span", span).where("span > 0").join(trend, ["instrument", "time"])
    return with_trend.where(F.col("htf_trend").isin("undefined") | (F.col("htf_trend") == F.col("direction")))


@query("confluence_score", f"WITH {BREAKS}, {FACTORS} SELECT instrument, idx, round({SCORE}, 6) AS score FROM f")
def confluence_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("instrument", "idx", *rounded("score"))


@query(
    "entry_signals",
    f"""WITH {BREAKS}, {FACTORS}, {ENTRIES} SELECT instrument, idx, direction, round(close, 6) AS price, round(CASE WHEN direction = 'bullish' THEN close - 1.5 * span ELSE close + 1.5 * span END, 6) AS stop,
    round(CASE WHEN direction = 'bullish' THEN close + 3 * span ELSE close - 3 * span END, 6) AS target FROM e""",
)
def entry_signals(spark, sf_dir):
    sign = F.when(F.col("direction") == "bullish", 1).otherwise(-1)
    return _entries(spark, sf_dir).select(
        "instrument",
        "idx",
        "direction",
        F.round("close", 6).alias("price"),
        F.round(F.col("close") - sign * 1.5 * F.col("span"), 6).alias("stop"),
        F.round(F.col("close") + sign * 3 * F.col("span"), 6).alias("target"),
    )


@query(
    "position_size",
    """WITH t AS (SELECT o_orderkey AS id, o_totalprice AS equity, 1 + o_orderkey % 50 AS distance, CASE WHEN o_totalprice < 50000 THEN 0.02 WHEN o_totalprice < 150000 THEN 0.01 ELSE 0.005 END AS risk FROM orders)
    SELECT id, risk::DOUBLE AS risk, round(CASE WHEN floor(equity * risk / (distance * 10.0) / 0.1 + 1e-9) * 0.1 >= 0.5 THEN floor(equity * risk / (distance * 10.0) / 0.1 + 1e-9) * 0.1 ELSE 0 END, 6) AS size FROM t""",
)
def position_size(spark, sf_dir):
    equity = F.col("o_totalprice")
    risk = F.when(equity < 50_000, 0.02).when(equity < 150_000, 0.01).otherwise(0.005)
    size = M.risk_size(equity, risk, 1 + F.col("o_orderkey") % 50, 10.0, 0.1, 0.5)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), risk.alias("risk"), F.round(size, 6).alias("size"))


GAMMA = """CASE WHEN floor(money / 40.0 / 0.1 + 1e-9) * 0.1 < 0.1 THEN NULL WHEN proba >= 0.9 THEN floor(money / 40.0 / 0.1 + 1e-9) * 0.1
    ELSE floor(pow(greatest((proba - 0.4) / 0.5, 0), 2.0) * (floor(money / 40.0 / 0.1 + 1e-9) * 0.1) / 0.1 + 1e-9) * 0.1 END"""


@query(
    "gamma_size",
    f"""WITH t AS (SELECT o_orderkey AS id, (o_orderkey % 101) / 100.0::DOUBLE AS proba, (o_orderkey % 37) * 7.0::DOUBLE AS money FROM orders), s AS (SELECT *, {GAMMA} AS raw FROM t)
    SELECT id, CASE WHEN raw >= 0.1 THEN round(raw, 6) END AS size, round(ceil(50 / ((1 + id % 30) * 10.0) / 0.1 - 1e-9) * 0.1, 6) AS least_size FROM s""",
)
def gamma_size(spark, sf_dir):
    key = F.col("o_orderkey")
    size = M.gamma_size((key % 101) / 100.0, 0.4, 2.0, 0.9, (key % 37) * 7.0, F.lit(40.0), 0.1)
    least = M.least_risk_size(F.lit(50.0), (1 + key % 30).cast("double"), 10.0, 0.1)
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.round(size, 6).alias("size"), F.round(least, 6).alias("least_size"))


@query("fill_price", f"WITH {TICKS} SELECT seq, round(CASE WHEN seq % 2 = 0 THEN ask ELSE bid END, 6) AS fill FROM ticks")
def fill_price(spark, sf_dir):
    return ticks(spark, sf_dir).select("seq", F.round(M.adverse_fill(F.col("bid"), F.col("ask"), F.col("seq") % 2 == 0), 6).alias("fill"))


UNIT = "(('0x' || left(md5(seq::VARCHAR || ':{salt}'), 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(
    "fill_slipped",
    f"""WITH {TICKS}, d AS (SELECT seq, seq % 2 = 0 AS buy, bid, ask, {UNIT.format(salt='reject7')} >= 0.05 AS filled, {UNIT.format(salt='slip7')} * 0.02 * (1 + seq % 3) AS slip FROM ticks)
    SELECT seq, filled, round(CASE WHEN NOT filled THEN bid WHEN buy THEN ask + slip ELSE bid - slip END, 6) AS price, round(CASE WHEN filled AND buy THEN ask - bid ELSE 0 END, 6) AS spread_cost, round(CASE WHEN filled THEN slip ELSE 0 END, 6) AS slippage FROM d""",
)
def fill_slipped(spark, sf_dir):
    """Orders at the bid: one in twenty is refused, the others slip by up to three times 0.02."""
    filled = M.slipped_fill(F.col("bid"), F.col("ask") - F.col("bid"), F.col("seq") % 2 == 0, F.col("seq"), 0.02 * (1 + F.col("seq") % 3), 0.05, 7)
    return ticks(spark, sf_dir).select("seq", filled["filled"].alias("filled"), *[F.round(filled[c], 6).alias(c) for c in ("price", "spread_cost", "slippage")])


@query("swap_cost", f"WITH {TRADES} SELECT trade_id, round(-0.5 * 0.0001 * size * (1 + trade_id % 5), 8) AS swap FROM trades")
def swap_cost(spark, sf_dir):
    return trades(spark, sf_dir).select("trade_id", F.round(F.lit(-0.5) * 0.0001 * F.col("size") * (1 + F.col("trade_id") % 5), 8).alias("swap"))


@query(
    "threshold_signal",
    """WITH p AS (SELECT event_id AS id, (event_id % 7) / 10.0::DOUBLE AS buy, (event_id % 11) / 15.0::DOUBLE AS sell FROM events)
    SELECT id, CASE WHEN buy >= 0.4 AND buy > sell THEN 'buy' WHEN sell >= 0.4 AND sell > buy THEN 'sell' ELSE 'none' END AS signal FROM p""",
)
def threshold_signal(spark, sf_dir):
    buy, sell = F.col("event_id") % 7 / 10.0, F.col("event_id") % 11 / 15.0
    signal = F.when((buy >= 0.4) & (buy > sell), "buy").when((sell >= 0.4) & (sell > buy), "sell").otherwise("none")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), signal.alias("signal"))


@query(
    "mr_tf_direction",
    f"""WITH {BARS}, d AS (SELECT instrument, idx, close / avg(close) OVER {frame(20)} - 1 AS dev, close / lag(close, 6) OVER {W} - 1 AS roc FROM bars)
    SELECT instrument, idx, CASE WHEN round(dev, 9) < -0.01 THEN 1 WHEN round(dev, 9) > 0.01 THEN -1 ELSE 0 END AS mean_reversion, CASE WHEN round(roc, 9) > 0.001 THEN 1 WHEN round(roc, 9) < -0.001 THEN -1 ELSE 0 END AS trend FROM d""",
)
def mr_tf_direction(spark, sf_dir):
    own = bounded(
        bars(spark, sf_dir),
        lambda w: {"dev": F.round(F.col("close") / F.avg("close").over(w.rowsBetween(-19, 0)) - 1, 9), "roc": F.round(F.col("close") / F.lag("close", 6).over(w) - 1, 9)},
        back=19,
    )
    dev, roc = F.col("dev"), F.col("roc")
    return own.select("instrument", "idx", F.when(dev < -0.01, 1).when(dev > 0.01, -1).otherwise(0).alias("mean_reversion"), F.when(roc > 0.001, 1).when(roc < -0.001, -1).otherwise(0).alias("trend"))


#: The 39 words, as the SQL looks for them.
WORDS = (
    "fed|ecb|boj|boe|rate|inflation|cpi|gdp|employment|nfp|payroll|unemployment|tariff|trade war|sanction|recession|crash|crisis|war|oil|gold"
    "|treasury|bond|yield|dollar|euro|yen|pound|stock market|wall street|s&p|nasdaq|dow|dax|nikkei|forex|currency|central bank|stimulus"
)


@query("macro_relevant", f"SELECT doc_id, coalesce(regexp_matches(lower(text), '{WORDS}'), false) AS relevant FROM documents")
def macro_relevant(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.macro_relevant(F.col("text")).alias("relevant"))


@query(
    "improvement_gate",
    f"""WITH {TRADES}, t AS (SELECT *, trade_id % 2 AS half FROM trades), c AS (SELECT *, row_number() OVER w AS nth, 100000 + sum(pnl) OVER w AS equity FROM t WINDOW w AS (PARTITION BY account, half ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY account, half ORDER BY nth ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
    m AS (SELECT account, half, coalesce(CASE WHEN count(*) > 1 THEN avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) END, 0) AS sharpe, 100 * arg_max((peak - equity) / peak, round(peak - equity, 2) * 1000000 - nth) AS fall FROM d GROUP BY 1, 2),
    p AS (SELECT o.account, CASE WHEN o.sharpe <> 0 THEN round((n.sharpe - o.sharpe) / abs(o.sharpe) * 100, 4) ELSE 100 END AS change, round(n.fall - o.fall, 6) AS deeper FROM m o JOIN m n ON n.account = o.account WHERE o.half = 0 AND n.half = 1)
    SELECT account, change, deeper, CASE WHEN change < 2 THEN 'insufficient' WHEN change > 200 THEN 'suspicious' WHEN deeper > 5 THEN 'drawdown' ELSE 'accepted' END AS verdict FROM p""",
)
def improvement_gate(spark, sf_dir):
    """The even trades of an account as the strategy before a change, the odd ones as that after it."""
    halves = S.trade_metrics(trades(spark, sf_dir).withColumn("half", F.col("trade_id") % 2), "account", "half", capital=100_000.0)
    sides = [halves.where(F.col("half") == k).select("account", F.col("sharpe").alias(f"{n}_sharpe"), (F.col("max_dd_pct") * 100).alias(f"{n}_fall")) for k, n in enumerate(("old", "new"))]
    change, deeper, verdict = M.improvement(F.col("old_sharpe"), F.col("new_sharpe"), F.col("old_fall"), F.col("new_fall"), jump=200.0)
    return sides[0].join(sides[1], "account").select("account", change.alias("change"), deeper.alias("deeper"), verdict.alias("verdict"))


@query(
    "trial_score",
    f"""WITH {TRADES}, c AS (SELECT *, row_number() OVER w AS nth, 100000 + sum(pnl) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY account ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY account ORDER BY nth ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
    s AS (SELECT account, count(*) AS n, sum(pnl) AS total, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 0) AS sharpe, arg_max((peak - equity) / peak, round(peak - equity, 2) * 1000000 - nth) AS fall,
      coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS lost, won < lost AS losing FROM d GROUP BY 1)
    SELECT account, n, round(total * (1 + sharpe) * (1 + 0.2 * CASE WHEN lost > 0 THEN least(won / lost, 5) ELSE 5 END), 2) AS balanced, round(CASE WHEN n < 5 OR fall > 0.2 OR losing OR sharpe < 0 THEN -10 ELSE total / 100000 * sharpe * n END, 4) AS score, round(total - greatest(10 - n, 0) * 50, 2) AS penalised FROM s""",
)
def trial_score(spark, sf_dir):
    own = S.trade_metrics(trades(spark, sf_dir), "account", capital=100_000.0)
    score = S.trial_score(100_000.0, 5, 0.2)
    return own.select("account", F.col("n_trades").alias("n"), F.round(score, 4).alias("score"), F.round(S.balanced_score(), 2).alias("balanced"), F.round(F.col("total_pnl") - F.greatest(10 - F.col("n_trades"), F.lit(0)) * 50, 2).alias("penalised"))


@query("trade_convert", f"WITH {TRADES} SELECT trade_id, CASE WHEN trade_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, opened_at, round(pnl / nullif(entry_price * 0.01 * size, 0), 8) AS r_multiple, round(pnl / 1000, 6) AS pnl_percent FROM trades")
def trade_convert(spark, sf_dir):
    risk = F.nullif(F.col("entry_price") * 0.01 * F.col("size"), F.lit(0.0))
    return trades(spark, sf_dir).select(
        "trade_id", F.when(F.col("trade_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), "opened_at", F.round(F.col("pnl") / risk, 8).alias("r_multiple"), F.round(F.col("pnl") / 1000, 6).alias("pnl_percent")
    )


@query("dedup_title", "SELECT doc_id, lower(left(text, 60)) AS title_key FROM documents QUALIFY row_number() OVER (PARTITION BY lower(left(text, 60)) ORDER BY doc_id) = 1")
def dedup_title(spark, sf_dir):
    titled = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(60)).alias("title"))
    return N.dedup_title(titled, "doc_id").select("doc_id", F.lower("title").alias("title_key"))


@query("sentiment_majority", "SELECT user_id, count(*) FILTER (event_type = 'view') AS bullish, count(*) FILTER (event_type = 'click') AS bearish, CASE WHEN bullish > bearish THEN 'bullish' WHEN bearish > bullish THEN 'bearish' ELSE 'neutral' END AS majority FROM events GROUP BY 1")
def sentiment_majority(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("bullish"), F.count_if(F.col("event_type") == "click").alias("bearish"))
    verdict = F.when(F.col("bullish") > F.col("bearish"), "bullish").when(F.col("bearish") > F.col("bullish"), "bearish").otherwise("neutral")
    return own.withColumn("majority", verdict)


REPLIES = (
    "ACTION: directional\nIMPACT_SCORE: {}\nINSTRUMENTS:\n  EUR/USD: bullish\n  NIKKEI225: bearish\n  XAU: Bullish\nREASONING: rate cut",
    "ACTION: tighten_stops\nIMPACT_SCORE: {}\nREASONING: a: b",
    "  ACTION: PAUSE \nIMPACT_SCORE: n/a\nSENTIMENT: Bearish",
    "ACTION: trigger\nINSTRUMENTS:\n A: none\n A: bearish\n B: sideways\nREASONING:",
    "",
    "IMPACT_SCORE: {}\nINSTRUMENTS:\nEUR/USD: BULLISH\nIMPACT_SCORE: 0.3\nGBP: bearish",
)


@query(
    "parse_reply",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'directional' WHEN 1 THEN 'tighten_stops' WHEN 2 THEN 'pause' ELSE 'none' END AS action,
    CASE event_id % 6 WHEN 0 THEN (event_id % 13) / 10.0::DOUBLE WHEN 1 THEN (event_id % 13) / 10.0::DOUBLE WHEN 5 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS score,
    CASE event_id % 6 WHEN 0 THEN 'bullish' WHEN 2 THEN 'bearish' WHEN 3 THEN 'bearish' WHEN 5 THEN 'bullish' ELSE 'neutral' END AS sentiment,
    CASE event_id % 6 WHEN 0 THEN 'rate cut' WHEN 1 THEN 'a: b' ELSE '' END AS reasoning,
    CASE event_id % 6 WHEN 0 THEN 'EUR/USD=bullish,NIKKEI225=bearish,XAU=bullish' WHEN 3 THEN 'A=bearish' WHEN 5 THEN 'EUR/USD=bullish' ELSE '' END AS sentiments FROM events""",
)
def parse_reply(spark, sf_dir):
    key = F.col("event_id")
    score = (key % 13 / 10.0).cast("string")
    text = F.replace(F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (key % 6 + 1).cast("int")), F.lit("{}"), score)
    parsed = N.parse_reply(text)
    votes = F.array_join(F.transform(F.map_entries(parsed["sentiments"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf_dir, "events").select("event_id", *[parsed[c].alias(c) for c in ("action", "score", "sentiment", "reasoning")], votes.alias("sentiments"))


@query("impact_band", "SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'high' WHEN value / 100 >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM events")
def impact_band(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.banded(F.col("value") / 100, 0.7, 0.4).alias("band"))


CODES = "CASE k % 7 WHEN 0 THEN 'pause' WHEN 1 THEN 'tighten_stops' WHEN 2 THEN 'directional' WHEN 3 THEN 'directional' WHEN 4 THEN 'directional' ELSE 'none' END"
STORED = ("pause", "tighten_stops", "directional", "trigger_entry", "close_opposing", "none", "unheard of")


def action_of(k):
    return N.known_action(F.get(F.array(*[F.lit(n) for n in STORED]), (k % 7).cast("int")))


@query("news_action", f"WITH n AS (SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events) SELECT event_id, k, coalesce({CODES}, 'none') AS action FROM n")
def news_action(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), action_of(k).alias("action"))


@query(
    "news_pause",
    f"""WITH {BARS}, {NEWS}, p AS (SELECT currency, time AS begins, time + INTERVAL '3 hours' AS ends FROM news WHERE {CODES} = 'pause')
    SELECT b.instrument, b.time, EXISTS (SELECT 1 FROM p WHERE p.currency = b.instrument AND b.time >= p.begins AND b.time < p.ends) AS paused FROM bars b""",
)
def news_pause(spark, sf_dir):
    from tickloom.operators.asof import asof_join

    pauses = news(spark, sf_dir).where(action_of(F.col("k")) == "pause").select(F.col("currency").alias("instrument"), "time").distinct()
    begun = pauses.withColumn("begins", F.col("time"))
    joined = asof_join(raw_bars(spark, sf_dir).select("instrument", "time"), begun, ["instrument"], ["begins"])
    return joined.select("instrument", "time", F.coalesce(F.col("time") < F.col("begins") + F.expr("INTERVAL 3 HOURS"), F.lit(False)).alias("paused"))


def _dated(df):
    """Dates as text, which both engines hold alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


ACCOUNT_SPANS = "s AS (SELECT o_custkey AS account, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1)"


def _account_spans(spark, sf_dir):
    return V.spans(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "account"), ["account"], "o_orderdate")


@query(
    "wf_windows_month",
    f"""WITH {ACCOUNT_SPANS}, k AS (SELECT account, last, make_date(year(first), month(first), least(day(first), 28)) AS begins, i FROM s, range(0, 400) r(i)),
    w AS (SELECT account, last, i::BIGINT AS "window", (begins + to_months(3 * i::INT))::DATE AS train_start, (begins + to_months(3 * i::INT + 12))::DATE AS test_start, (begins + to_months(3 * i::INT + 15))::DATE AS test_end FROM k)
    SELECT account, "window", train_start::VARCHAR AS train_start, test_start::VARCHAR AS test_start, test_end::VARCHAR AS test_end FROM w WHERE test_end <= last""",
)
def wf_windows_month(spark, sf_dir):
    """Windows of each account's own history of orders."""
    return _dated(V.month_windows(_account_spans(spark, sf_dir), 12, 3))


def _days_sql(spans: str, key: str, train: int, test: int, step: int, validation: int = 0) -> str:
    ends = f", (first + {step} * i::INT + {train + test + validation})::DATE AS validation_end" if validation else ""
    last, shown = ("validation_end", ", validation_end::VARCHAR AS validation_end") if validation else ("test_end", "")
    return f"""WITH {spans}, w AS (SELECT {key}, last, i::BIGINT AS "window", (first + {step} * i::INT)::DATE AS train_start, (first + {step} * i::INT + {train})::DATE AS test_start, (first + {step} * i::INT + {train + test})::DATE AS test_end{ends} FROM s, range(0, 2000) r(i))
    SELECT {key}, "window", train_start::VARCHAR AS train_start, test_start::VARCHAR AS test_start, test_end::VARCHAR AS test_end{shown} FROM w WHERE {last} <= last"""


@query("wf_windows_days", _days_sql("s AS (SELECT user_id, min(ts)::DATE AS first, max(ts)::DATE AS last FROM events GROUP BY 1)", "user_id", 10, 4, 4, 2))
def wf_windows_days(spark, sf_dir):
    """Windows of each user's own events, with a validation range."""
    return _dated(V.day_windows(V.spans(table(spark, sf_dir, "events"), ["user_id"], "ts"), 10, 4, 4, validation=2))


MONDAY_SPANS = """raw AS (SELECT o_orderpriority AS source, o_orderstatus AS status, min(o_orderdate)::DATE AS d, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1, 2),
    s AS (SELECT source, status, (d + (8 - isodow(d)::INT) % 7)::DATE AS first, last FROM raw)"""


@query("wf_windows_monday", _days_sql(MONDAY_SPANS, "source, status", 28, 7, 7))
def wf_windows_monday(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return _dated(V.day_windows(V.spans(own, ["source", "status"], "o_orderdate"), 28, 7, 7, to_monday=True))


@query(
    "month_ranges",
    f"""WITH {ACCOUNT_SPANS}, m AS (SELECT account, first, last, unnest(generate_series(date_trunc('month', first), last::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM s),
    r AS (SELECT account, greatest(m, first)::DATE AS range_start, least(m + INTERVAL 1 MONTH, last)::DATE AS range_end FROM m)
    SELECT account, range_start::VARCHAR AS range_start, range_end::VARCHAR AS range_end FROM r WHERE range_start < range_end""",
)
def month_ranges(spark, sf_dir):
    return _dated(V.month_ranges(_account_spans(spark, sf_dir)))


@query(
    "trading_days",
    "SELECT o_orderkey, greatest(1, (SELECT count(*) FROM range(0, (o_orderkey % 30)::BIGINT) r(i) WHERE isodow(o_orderdate::DATE + i::INT) < 6))::BIGINT AS days FROM orders",
)
def trading_days(spark, sf_dir):
    start, span = F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")
    days = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(span - 1, F.lit(0))), lambda i: F.date_add(start, i)), lambda d: F.weekday(d) < 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.lit(1), F.when(span > 0, F.size(days)).otherwise(0)).cast("long").alias("days"))


SEGMENTS = f"""{BARS}, g AS (SELECT *, CASE WHEN time - lag(time) OVER {W} <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM bars),
  seg AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM g)"""


@query("segments", f"WITH {SEGMENTS} SELECT instrument, segment::BIGINT AS segment, count(*) AS n, min(time) AS begins, max(time) AS ends FROM seg GROUP BY 1, 2 HAVING count(*) >= 4")
def segments(spark, sf_dir):
    own = V.segments(bars(spark, sf_dir), 7200).groupBy("instrument", "segment").agg(F.count("*").alias("n"), F.min("time").alias("begins"), F.max("time").alias("ends"))
    return own.where("n >= 4")


@query(
    "sequence_index",
    f"""WITH {SEGMENTS}, s AS (SELECT instrument, segment, count(*) AS n, min(idx) AS first_idx FROM seg GROUP BY 1, 2 HAVING count(*) >= 4), o AS (SELECT instrument, segment, first_idx, unnest(range(0, n - 3, 2)) AS "offset" FROM s)
    SELECT instrument, segment::BIGINT AS segment, "offset", first_idx + "offset" AS start_idx FROM o""",
)
def sequence_index(spark, sf_dir):
    return V.sequences(V.segments(bars(spark, sf_dir), 7200), 4, 2)


@query(
    "chrono_split",
    f"""WITH {BARS}, n AS (SELECT *, count(*) OVER (PARTITION BY instrument) AS n FROM bars) SELECT instrument, idx, CASE WHEN idx < floor(n * 0.9) - 5 THEN 'train' WHEN idx < floor(n * 0.9) THEN 'purge' ELSE 'validation' END AS part FROM n""",
)
def chrono_split(spark, sf_dir):
    return V.chrono_split(bars(spark, sf_dir), 0.9, 5).select("instrument", "idx", "part")
