"""Queries: as-of joins, range joins, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import labels as L
from tickloom.operators import patterns as P
from tickloom.operators import selection as S
from tickloom.operators.asof import asof_join, range_join
from tickloom.operators.series import bounded, with_index
from tickloom.plans.base import BARS, TICKS, bars, bars_sql, query, raw_bars, rounded, table, ticks
from tickloom.plans.patterns import BREAKS, W
from tickloom.sources.scratch import stored

HTF = ("ret_open", "ret_high", "ret_low", "ret_close", "tick_count", "spread")


def _htf_returns(spark, sf_dir, width):
    rolled = with_index(B.candles(ticks(spark, sf_dir), width))
    prices = ("open", "high", "low", "close")
    out = bounded(rolled, lambda w: {f"ret_{c}": F.coalesce(F.col(c) / F.lag("close").over(w) - 1, F.lit(0.0)) for c in prices}, back=1)
    return out.select("instrument", "time", *HTF)


def _htf_sql(name, width):
    rets = ", ".join(f"coalesce({c} / lag(close) OVER {W} - 1, 0) AS ret_{c}" for c in ("open", "high", "low", "close"))
    return f"{bars_sql(name + '_raw', width)}, {name} AS (SELECT instrument, time, {rets}, tick_count, spread FROM {name}_raw)"


def _asof_sql(name, width, delay):
    values = ", ".join(f"round(coalesce(r.{c}, 0), 6) AS {c}" for c in HTF if c != "tick_count")
    return f"""WITH {BARS}, {_htf_sql(name, width)}, r AS (SELECT * REPLACE (time + INTERVAL '{delay}' AS time) FROM {name})
      SELECT b.instrument, b.time, {values}, coalesce(r.tick_count, 0)::BIGINT AS tick_count FROM bars b ASOF LEFT JOIN r ON b.instrument = r.instrument AND b.time >= r.time"""


def _asof(width, delay):
    def run(spark, sf_dir):
        left = raw_bars(spark, sf_dir).select("instrument", "time")
        joined = asof_join(left, _htf_returns(spark, sf_dir, width), ["instrument"], HTF, delay)
        plain = [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in HTF if c != "tick_count"]
        return joined.select("instrument", "time", *plain, F.coalesce("tick_count", F.lit(0)).alias("tick_count"))

    return run


query("asof_h1", _asof_sql("htf", "1 day", "1 day"))(_asof("1 day", "1 day"))
query("asof_m5", _asof_sql("htf", "4 hours", "4 hours"))(_asof("4 hours", "4 hours"))


def _returns_sql(width):
    return f"WITH {TICKS}, {_htf_sql('htf', width)} SELECT instrument, time, {', '.join(f'round({c}, 6) AS {c}' for c in HTF if c != 'tick_count')}, tick_count FROM htf"


def _returns(width):
    return lambda spark, sf_dir: _htf_returns(spark, sf_dir, width).select("instrument", "time", *rounded(*[c for c in HTF if c != "tick_count"]), "tick_count")


query("h1_returns", _returns_sql("1 day"))(_returns("1 day"))
query("m5_returns", _returns_sql("4 hours"))(_returns("4 hours"))


@query(
    "asof_cross",
    f"""WITH {BARS}, l AS (SELECT time, close FROM bars WHERE instrument = 'view'), r AS (SELECT time, close, tick_count FROM bars WHERE instrument = 'click')
    SELECT l.time, round(l.close, 6) AS close, round(coalesce(r.close, 0), 6) AS cross_close, coalesce(r.tick_count, 0)::BIGINT AS cross_ticks FROM l ASOF LEFT JOIN r ON l.time >= r.time""",
)
def asof_cross(spark, sf_dir):
    own = raw_bars(spark, sf_dir)
    left = own.where("instrument = 'view'").select(F.lit("pair").alias("pair"), "time", "close")
    right = own.where("instrument = 'click'").select(F.lit("pair").alias("pair"), "time", F.col("close").alias("cross_close"), F.col("tick_count").alias("cross_ticks"))
    joined = asof_join(left, right, ["pair"], ["cross_close", "cross_ticks"])
    return joined.select(
        "time", *rounded("close"), F.round(F.coalesce("cross_close", F.lit(0.0)), 6).alias("cross_close"), F.coalesce("cross_ticks", F.lit(0)).alias("cross_ticks")
    )


@query(
    "dxy_proxy",
    f"""WITH {BARS}, l AS (SELECT time, close FROM bars WHERE instrument = 'view'), r AS (SELECT time, close FROM bars WHERE instrument = 'click'),
    j AS (SELECT l.time, -0.58 * l.close + 0.14 * coalesce(r.close, 0) AS proxy, row_number() OVER (ORDER BY l.time) - 1 AS idx FROM l ASOF LEFT JOIN r ON l.time >= r.time)
    SELECT time, round(proxy, 6) AS proxy, round(CASE WHEN idx >= 19 THEN avg(proxy) OVER f ELSE 0 END, 6) AS mean_20, round(CASE WHEN idx >= 19 THEN stddev_samp(proxy) OVER f ELSE 0 END, 6) AS vol_20
    FROM j WINDOW f AS (ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def dxy_proxy(spark, sf_dir):
    own = raw_bars(spark, sf_dir)
    left = own.where("instrument = 'view'").select(F.lit("pair").alias("instrument"), "time", "close")
    right = own.where("instrument = 'click'").select(F.lit("pair").alias("instrument"), "time", F.col("close").alias("other"))
    joined = with_index(asof_join(left, right, ["instrument"], ["other"]))
    proxied = joined.withColumn("proxy", -0.58 * F.col("close") + 0.14 * F.coalesce("other", F.lit(0.0)))
    rolled = bounded(
        proxied, lambda w: {"mean_20": F.avg("proxy").over(w.rowsBetween(-19, 0)), "vol_20": F.stddev_samp("proxy").over(w.rowsBetween(-19, 0))}, back=19
    )
    enough = F.col("idx") >= 19
    return rolled.select("time", *rounded("proxy"), *[F.round(F.when(enough, F.col(c)).otherwise(0.0), 6).alias(c) for c in ("mean_20", "vol_20")])


HTF_TREND_SQL = f"""WITH {BREAKS.replace(bars_sql('bars', '1 hour'), bars_sql('bars', '4 hours'))}, small AS (SELECT instrument, time_bucket(INTERVAL '1 hour', time) AS time FROM ticks GROUP BY 1, 2),
    r AS (SELECT instrument, time + INTERVAL '4 hours' AS time, arg_max(direction, rank) AS direction FROM breaks GROUP BY 1, 2)
    SELECT s.instrument, s.time, coalesce(r.direction, 'undefined') AS htf_trend FROM small s ASOF LEFT JOIN r ON s.instrument = r.instrument AND s.time >= r.time"""


@query("htf_trend", HTF_TREND_SQL)
def htf_trend(spark, sf_dir):
    return trend_of_wide_bars(stored(raw_bars(spark, sf_dir), "bars"))


def trend_of_wide_bars(own):
    """Trend of the last closed 4-hour bar at each hourly bar; the 4-hour bars are rolled up from the hourly ones."""
    wide = with_index(B.roll_up(own, "4 hours"))
    last = P.structure_breaks(wide).groupBy("instrument", "time").agg(F.max_by("direction", "rank").alias("htf_trend"))
    joined = asof_join(own.select("instrument", "time"), last, ["instrument"], ["htf_trend"], "4 hours")
    return joined.withColumn("htf_trend", F.coalesce("htf_trend", F.lit("undefined")))


@query(
    "bars_with_events",
    f"""WITH {BREAKS} SELECT b.instrument, b.idx, (SELECT count(*) FROM breaks k WHERE k.instrument = b.instrument AND k.idx = b.idx) AS n_breaks,
    coalesce((SELECT string_agg(k.direction || ' ' || k.kind, ',' ORDER BY k.rank) FROM breaks k WHERE k.instrument = b.instrument AND k.idx = b.idx), '') AS events FROM bars b""",
)
def bars_with_events(spark, sf_dir):
    own = bars(spark, sf_dir)
    event = F.struct("rank", F.concat_ws(" ", "direction", "kind").alias("name"))
    events = P.structure_breaks(own).groupBy("instrument", "idx").agg(F.array_sort(F.collect_list(event)).alias("found"))
    joined = own.join(events, ["instrument", "idx"], "left")
    names = F.transform("found", lambda e: e["name"])
    return joined.select("instrument", "idx", F.coalesce(F.array_size("found"), F.lit(0)).cast("long").alias("n_breaks"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("events"))


@query(
    "ms_lookback",
    f"""WITH {BREAKS} SELECT b.instrument, b.idx, count(k.idx) AS n_recent, coalesce(arg_max(k.direction, k.idx * 2 + k.rank), 'none') AS last_direction
    FROM bars b LEFT JOIN breaks k ON k.instrument = b.instrument AND k.idx BETWEEN b.idx - 9 AND b.idx GROUP BY 1, 2""",
)
def ms_lookback(spark, sf_dir):
    own = bars(spark, sf_dir)
    event = F.struct("idx", "rank", "direction")
    events = P.structure_breaks(own).groupBy("instrument", "idx").agg(F.array_sort(F.collect_list(event)).alias("found"))
    joined = own.join(events, ["instrument", "idx"], "left")
    recent = bounded(joined, lambda w: {"recent": F.flatten(F.collect_list("found").over(w.rowsBetween(-9, 0)))}, back=9)
    last = F.coalesce(F.try_element_at("recent", F.lit(-1))["direction"], F.lit("none"))
    return recent.select("instrument", "idx", F.size("recent").cast("long").alias("n_recent"), last.alias("last_direction"))


NEWS = "news AS (SELECT event_id AS id, ts AS time, event_type AS currency, (props::JSON->>'k')::BIGINT AS k FROM events)"


def news(spark, sf_dir):
    """All events as a news feed, their JSON code as content."""
    own = table(spark, sf_dir, "events")
    code = F.get_json_object("props", "$.k").cast("long")
    return own.select(F.col("event_id").alias("id"), F.col("ts").alias("time"), F.col("event_type").alias("currency"), code.alias("k"))


@query(
    "news_at_bar",
    f"""WITH {TICKS}, {bars_sql('bars', '1 minute')}, {NEWS} SELECT b.instrument, b.time, n.id, n.k FROM bars b JOIN news n ON n.currency = b.instrument AND date_trunc('minute', n.time) = b.time""",
)
def news_at_bar(spark, sf_dir):
    own = raw_bars(spark, sf_dir, "1 minute").select("instrument", "time")
    events = news(spark, sf_dir).select(F.col("currency").alias("instrument"), F.window("time", "1 minute")["start"].alias("time"), "id", "k")
    return own.join(events, ["instrument", "time"])


@query(
    "news_near",
    f"""WITH {BARS}, {NEWS} SELECT b.instrument, b.time, count(n.id) AS n_near, min(n.id) AS first_id FROM bars b
    LEFT JOIN news n ON n.currency = b.instrument AND n.time >= b.time - INTERVAL '30 minutes' AND n.time < b.time + INTERVAL '30 minutes' GROUP BY 1, 2""",
)
def news_near(spark, sf_dir):
    half = 30 * 60 * L.MICROS
    own = L.with_micros(raw_bars(spark, sf_dir).select("instrument", "time"))
    events = L.with_micros(news(spark, sf_dir)).select(F.col("currency").alias("instrument"), F.col("t").alias("tn"), "id")
    near = range_join(own, events, ["instrument"], "tn", F.col("t") - half, F.col("t") + half - 1, 2 * half)
    found = near.groupBy("instrument", "time").agg(F.count("id").alias("n_near"), F.min("id").alias("first_id"))
    return own.select("instrument", "time").join(found, ["instrument", "time"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


STOP, TARGET, TIMEOUT = 40.0, 60.0, 4 * 3600


def _labels_sql(stop: str, target: str) -> str:
    return f"""{BARS}, r AS (SELECT instrument, time, seq, bid, ask, row_number() OVER (PARTITION BY instrument ORDER BY time, seq) - 1 AS idx FROM ticks),
    a AS (SELECT r.*, {stop} AS stop, {target} AS target FROM r),
    h AS (SELECT a.instrument, a.idx, min(CASE WHEN p.bid <= a.ask - a.stop THEN p.idx END) AS bs, min(CASE WHEN p.bid >= a.ask + a.target THEN p.idx END) AS bt,
        min(CASE WHEN p.ask >= a.bid + a.stop THEN p.idx END) AS ss, min(CASE WHEN p.ask <= a.bid - a.target THEN p.idx END) AS st
      FROM a JOIN r p ON p.instrument = a.instrument AND p.idx > a.idx AND p.time <= a.time + INTERVAL '4 hours' GROUP BY 1, 2),
    o AS (SELECT a.instrument, a.idx, p.idx AS o, p.bid AS o_bid, p.ask AS o_ask FROM a ASOF JOIN r p ON p.instrument = a.instrument AND a.time + INTERVAL '4 hours' < p.time),
    lab AS (SELECT a.instrument, a.idx, a.time, a.bid, a.ask,
      CASE WHEN bs IS NOT NULL AND (bt IS NULL OR bs <= bt) THEN 0 WHEN bt IS NOT NULL THEN 1 WHEN o IS NOT NULL AND round(o_bid - a.ask, 9) > 0 THEN 1 WHEN o IS NOT NULL AND round(o_bid - a.ask, 9) < 0 THEN 0 ELSE -1 END AS buy_label,
      CASE WHEN ss IS NOT NULL AND (st IS NULL OR ss <= st) THEN 0 WHEN st IS NOT NULL THEN 1 WHEN o IS NOT NULL AND round(a.bid - o_ask, 9) > 0 THEN 1 WHEN o IS NOT NULL AND round(a.bid - o_ask, 9) < 0 THEN 0 ELSE -1 END AS sell_label,
      CASE WHEN bs IS NOT NULL AND (bt IS NULL OR bs <= bt) THEN -stop WHEN bt IS NOT NULL THEN target WHEN o IS NOT NULL THEN o_bid - a.ask ELSE 0 END AS buy_pnl,
      CASE WHEN ss IS NOT NULL AND (st IS NULL OR ss <= st) THEN -stop WHEN st IS NOT NULL THEN target WHEN o IS NOT NULL THEN a.bid - o_ask ELSE 0 END AS sell_pnl,
      CASE WHEN bs IS NOT NULL AND (bt IS NULL OR bs <= bt) THEN bs WHEN bt IS NOT NULL THEN bt ELSE o END AS buy_exit,
      CASE WHEN ss IS NOT NULL AND (st IS NULL OR ss <= st) THEN ss WHEN st IS NOT NULL THEN st ELSE o END AS sell_exit
    FROM a LEFT JOIN h USING (instrument, idx) LEFT JOIN o USING (instrument, idx))"""


LABELS = _labels_sql("40.0", "60.0")
OUT = "instrument, idx, buy_label, sell_label, round(buy_pnl, 6) AS buy_pnl, round(sell_pnl, 6) AS sell_pnl"


def _rows(spark, sf_dir):
    return with_index(ticks(spark, sf_dir), order=("time", "seq"), block="1 day")


def _fixed(spark, sf_dir):
    return L.barrier_labels(_rows(spark, sf_dir), F.lit(STOP), F.lit(TARGET), TIMEOUT)


@query("labels_fixed", f"WITH {LABELS} SELECT {OUT} FROM lab")
def labels_fixed(spark, sf_dir):
    return _fixed(spark, sf_dir).select("instrument", "idx", "buy_label", "sell_label", *rounded("buy_pnl", "sell_pnl"))


@query(
    "one_at_a_time",
    f"""WITH RECURSIVE {LABELS}, e AS MATERIALIZED (SELECT instrument, idx, buy_exit, round(buy_pnl, 6) AS buy_pnl FROM lab WHERE buy_label >= 0),
    n AS MATERIALIZED (SELECT a.instrument, a.idx, b.idx AS follows FROM e a ASOF JOIN e b ON a.instrument = b.instrument AND a.buy_exit <= b.idx),
    taken AS (SELECT instrument, min(idx) AS idx FROM e GROUP BY 1 UNION ALL SELECT n.instrument, n.follows FROM taken t JOIN n ON n.instrument = t.instrument AND n.idx = t.idx)
    SELECT e.* FROM e JOIN taken USING (instrument, idx)""",
)
def one_at_a_time(spark, sf_dir):
    """Of all decided buys of each instrument, those that a trader with one position takes."""
    entries = _fixed(spark, sf_dir).where("buy_label >= 0").select("instrument", "idx", F.col("buy_exit").alias("exit_idx"), *rounded("buy_pnl"))
    return S.one_at_a_time(entries).withColumnRenamed("exit_idx", "buy_exit")


MEAN = "(SELECT CASE WHEN x > 0 THEN x ELSE NULL END FROM (SELECT avg(q.high - q.low) AS x FROM bars q WHERE q.instrument = r.instrument AND q.time < time_bucket(INTERVAL '1 hour', r.time) AND q.time >= time_bucket(INTERVAL '1 hour', r.time) - INTERVAL '14 hours'))"


@query(
    "labels_atr",
    "WITH " + _labels_sql("coalesce(0.8 * m.atr, 40.0)", "coalesce(1.2 * m.atr, 60.0)").replace(
        "FROM r),\n    h AS", "FROM r LEFT JOIN m ON m.instrument = r.instrument AND m.time = time_bucket(INTERVAL '1 hour', r.time)),\n    h AS"
    ).replace("    a AS (", "    m AS (SELECT instrument, time, nullif(round(atr, 6), 0) AS atr FROM (SELECT instrument, time, avg(high - low) OVER (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS atr FROM bars)),\n    a AS (")
    + f" SELECT {OUT} FROM lab",
)
def labels_atr(spark, sf_dir):
    own = bounded(bars(spark, sf_dir), lambda w: {"atr": F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-14, -1))}, back=14)
    ranges = own.select("instrument", F.col("time").alias("hour"), F.round("atr", 6).alias("atr"))
    rows = _rows(spark, sf_dir).withColumn("hour", F.window("time", "1 hour")["start"]).join(ranges, ["instrument", "hour"], "left")

    def scaled(k, fixed):
        return F.when(F.col("atr") > 0, F.col("atr") * k).otherwise(fixed)

    labels = L.barrier_labels(rows, scaled(0.8, STOP), scaled(1.2, TARGET), TIMEOUT)
    return labels.select("instrument", "idx", "buy_label", "sell_label", *rounded("buy_pnl", "sell_pnl"))


TARGETED = "CASE WHEN buy_label = 1 AND sell_label <> 1 THEN 1 WHEN sell_label = 1 AND buy_label <> 1 THEN 2 ELSE 0 END"


def _target():
    buy, sell = F.col("buy_label") == 1, F.col("sell_label") == 1
    return F.when(buy & ~sell, 1).when(sell & ~buy, 2).otherwise(0)


@query(
    "exit_dataset",
    f"""WITH {LABELS}, e AS (SELECT *, {TARGETED} AS d FROM lab),
    t AS (SELECT instrument, idx, time, d, CASE WHEN d = 1 THEN ask ELSE bid END AS entry, CASE WHEN d = 1 THEN buy_exit ELSE sell_exit END AS leave, CASE WHEN d = 1 THEN buy_pnl ELSE sell_pnl END AS final FROM e WHERE d > 0)
    SELECT t.instrument, t.idx AS entry_index, r.idx AS row_index, CASE WHEN d = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction, round(CASE WHEN d = 1 THEN r.bid - entry ELSE entry - r.ask END, 6) AS unrealized,
      round((epoch_us(r.time) - epoch_us(t.time)) / 1000000.0, 3)::DOUBLE AS duration, (round(CASE WHEN d = 1 THEN r.bid - entry ELSE entry - r.ask END, 9) > round(final, 9))::INT AS label
    FROM t JOIN r ON r.instrument = t.instrument AND r.idx BETWEEN t.idx + 1 AND leave WHERE leave IS NOT NULL""",
)
def exit_dataset(spark, sf_dir):
    paths = L.exit_paths(_fixed(spark, sf_dir), _rows(spark, sf_dir), _target())
    return paths.withColumns({"unrealized": F.round("unrealized", 6), "duration": F.round("duration", 3)})


@query("entry_target", f"WITH {LABELS} SELECT instrument, idx, {TARGETED} AS target, round(abs(CASE WHEN {TARGETED} = 2 THEN sell_pnl ELSE buy_pnl END) + 1, 6) AS weight FROM lab")
def entry_target(spark, sf_dir):
    own = _fixed(spark, sf_dir).withColumn("target", _target())
    pnl = F.when(F.col("target") == 2, F.col("sell_pnl")).otherwise(F.col("buy_pnl"))
    return own.select("instrument", "idx", "target", F.round(F.abs(pnl) + 1, 6).alias("weight"))


@query("valid_labels", f"WITH {LABELS} SELECT instrument, idx, buy_label, sell_label FROM lab WHERE NOT (buy_label = -1 AND sell_label = -1)")
def valid_labels(spark, sf_dir):
    return _fixed(spark, sf_dir).where(~((F.col("buy_label") == -1) & (F.col("sell_label") == -1))).select("instrument", "idx", "buy_label", "sell_label")


@query(
    "label_counts",
    f"""WITH {LABELS}, u AS (SELECT instrument, 'buy' AS side, buy_label AS label FROM lab UNION ALL SELECT instrument, 'sell', sell_label FROM lab)
    SELECT instrument, side, count(*) FILTER (label = 1) AS wins, count(*) FILTER (label = 0) AS losses, count(*) FILTER (label = -1) AS timeouts FROM u GROUP BY 1, 2""",
)
def label_counts(spark, sf_dir):
    own = _fixed(spark, sf_dir)
    sides = own.select("instrument", F.lit("buy").alias("side"), F.col("buy_label").alias("label")).unionByName(own.select("instrument", F.lit("sell").alias("side"), F.col("sell_label").alias("label")))
    return sides.groupBy("instrument", "side").agg(*[F.count_if(F.col("label") == v).alias(n) for n, v in (("wins", 1), ("losses", 0), ("timeouts", -1))])


@query("class_dist", f"WITH {LABELS} SELECT {TARGETED} AS target, count(*) AS n FROM lab GROUP BY 1")
def class_dist(spark, sf_dir):
    return _fixed(spark, sf_dir).groupBy(_target().alias("target")).agg(F.count("*").alias("n"))


@query(
    "labels_bar",
    f"""WITH {BARS}, e AS (SELECT instrument, idx, time, lead(open) OVER {W} AS entry, lead(open, 12) OVER {W} AS tail FROM bars),
    h AS (SELECT e.instrument, e.idx, min(CASE WHEN p.low <= e.entry - 30 THEN p.idx END) AS s, min(CASE WHEN p.high >= e.entry + 30 THEN p.idx END) AS g
      FROM e JOIN bars p ON p.instrument = e.instrument AND p.idx BETWEEN e.idx + 1 AND e.idx + 12 GROUP BY 1, 2)
    SELECT e.instrument, e.idx, e.time, round(e.entry, 6) AS entry, CASE WHEN tail IS NOT NULL THEN (g IS NOT NULL AND (s IS NULL OR g < s))::INT END AS label FROM e LEFT JOIN h USING (instrument, idx)""",
)
def labels_bar(spark, sf_dir):
    return L.bar_labels(bars(spark, sf_dir), 12, 30.0, 30.0).withColumn("entry", F.round("entry", 6))


@query("dim_mapping", "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_mapping(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("anti_existing", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_existing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "sentiment_lookup",
    """SELECT event_id, event_type, coalesce(CASE event_type WHEN 'view' THEN 'bullish' WHEN 'click' THEN 'bearish' END, 'neutral') AS sentiment FROM events""",
)
def sentiment_lookup(spark, sf_dir):
    votes = F.create_map(*[F.lit(x) for x in ("view", "bullish", "click", "bearish", "__all__", "neutral")])
    found = F.coalesce(F.try_element_at(votes, F.col("event_type")), F.try_element_at(votes, F.lit("__all__")))
    return table(spark, sf_dir, "events").select("event_id", "event_type", found.alias("sentiment"))
