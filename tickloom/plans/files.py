"""Queries: files written in a layout and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.rolling import scalping
from tickloom.plans.base import BARS, TICKS, TRADES, bars, bars_sql, query, raw_bars, rounded, table, ticks, trades
from tickloom.plans.patterns import W
from tickloom.operators.refresh import RollUps
from tickloom.sources import readers as R
from tickloom.sources.scratch import scratch_path

OHLC = ("open", "high", "low", "close")
#: What was written comes back: the bars without their instrument, tick counts as volume.
WRITTEN = f"WITH {BARS} SELECT time, {', '.join(f'round({c}, 6) AS {c}' for c in OHLC)}, tick_count::DOUBLE AS volume FROM bars"


def _csv(spark, df, label):
    path = scratch_path(spark, label)
    df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


@query("csv_generic", WRITTEN)
def csv_generic(spark, sf_dir):
    own = raw_bars(spark, sf_dir).select(F.col("time").alias("Date"), *[F.col(c).alias(c[0].upper()) for c in OHLC], F.col("tick_count").alias("Vol"))
    return R.candles_csv(spark, _csv(spark, own, "generic")).select("time", *rounded(*OHLC), "volume")


@query("csv_fxcm", WRITTEN)
def csv_fxcm(spark, sf_dir):
    own = raw_bars(spark, sf_dir).select(F.date_format("time", "MM/dd/yyyy HH:mm:ss.SSS").alias("DateTime"), *[F.col(c).alias(f"Bid{c.title()}") for c in OHLC], F.col("tick_count").alias("TickQty"))
    return R.bid_candles_csv(spark, _csv(spark, own, "bids")).select("time", *rounded(*OHLC), "volume")


@query("csv_metatrader", WRITTEN)
def csv_metatrader(spark, sf_dir):
    own = raw_bars(spark, sf_dir).select(F.date_format("time", "yyyy.MM.dd").alias("Date"), F.date_format("time", "HH:mm:ss").alias("Time"), *[F.col(c).alias(c.title()) for c in OHLC], F.col("tick_count").alias("TickVol"))
    return R.terminal_csv(spark, _csv(spark, own, "terminal")).select("time", *rounded(*OHLC), "volume")


@query("csv_dir_instrument", f"WITH {BARS} SELECT CASE instrument WHEN 'view' THEN 'EUR/USD' ELSE upper(instrument) END AS instrument, time, {', '.join(f'round({c}, 6) AS {c}' for c in OHLC)} FROM bars")
def csv_dir_instrument(spark, sf_dir):
    path = scratch_path(spark, "stems")
    raw_bars(spark, sf_dir).select("instrument", "time", *OHLC).write.partitionBy("instrument").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return R.directory_csv(spark, f"{path}/*", {"VIEW": "EUR/USD"}).select("instrument", "time", *rounded(*OHLC))


@query("csv_weekly_gz", WRITTEN)
def csv_weekly_gz(spark, sf_dir):
    own = raw_bars(spark, sf_dir).select(F.date_format("time", "MM/dd/yyyy HH:mm:ss.SSS").alias("DateTime"), *[F.col(c).alias(f"Bid{c.title()}") for c in OHLC], F.col("tick_count").alias("TickQty"), F.weekofyear("time").alias("week"))
    path = scratch_path(spark, "weeks")
    own.write.partitionBy("week").option("header", True).option("compression", "gzip").csv(path)
    return R.bid_candles_csv(spark, f"{path}/*").select("time", *rounded(*OHLC), "volume")


@query("months_sink", f"WITH {BARS} SELECT instrument, strftime(time, '%Y-%m') AS month, time, round(close, 6) AS close, tick_count FROM bars")
def months_sink(spark, sf_dir):
    """Candles written by instrument and month, one month again, and read back as a folder."""
    path, own = scratch_path(spark, "months"), raw_bars(spark, sf_dir).select("instrument", "time", *OHLC, "tick_count")
    R.write_months(own.where(F.month("time") == 1).withColumn("close", F.lit(0.0)), path)
    R.write_months(own, path)
    return R.candles_dir(spark, path).select("instrument", "month", "time", *rounded("close"), "tick_count")


@query(
    "params_file",
    f"""WITH {TRADES}, p AS (SELECT source AS name, CASE WHEN pnl > 0 THEN 'outer' ELSE 'inner' END AS part, abs(pnl) AS size FROM trades)
    SELECT part, name, round(quantile_cont(size, 0.5), 4) AS value, round(quantile_cont(size, 0.1), 4) AS low, round(quantile_cont(size, 0.9), 4) AS high FROM p GROUP BY 1, 2""",
)
def params_file(spark, sf_dir):
    """Targets (outer) and stops (inner) of each source, with ranges, learned from its trades, written and read back by part."""
    own = trades(spark, sf_dir).select(F.col("source").alias("name"), F.when(F.col("pnl") > 0, "outer").otherwise("inner").alias("part"), F.abs("pnl").alias("size"))
    shares = {"value": 0.5, "low": 0.1, "high": 0.9}
    path = scratch_path(spark, "params")
    R.write_params(own.groupBy("part", "name").agg(*[F.round(F.percentile("size", F.lit(q)), 4).alias(n) for n, q in shares.items()]), path)
    return R.read_params(spark, path)


@query(
    "trial_log",
    """SELECT p_brand AS run, p_partkey AS trial, round(p_retailprice / p_size, 4) AS score, p_size::DOUBLE AS outer__size, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS inner__price FROM part""",
)
def trial_log(spark, sf_dir):
    """Trials of each run written as CSV with a column for each parameter, and read back; odd sizes have no price."""
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "run", "p_partkey": "trial"})
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    sort = F.struct(F.lit("outer").alias("part"), F.lit("size").alias("name"), size.alias("value"))
    other = F.struct(F.lit("inner").alias("part"), F.lit("price").alias("name"), price.alias("value"))
    params = part.select("run", "trial", F.explode(F.array_compact(F.array(sort, F.when(F.col("p_size") % 2 == 0, other)))).alias("p")).select("run", "trial", "p.*")
    path = scratch_path(spark, "trials")
    R.write_trial_log(part.select("run", "trial", F.round(price / F.col("p_size"), 4).alias("score")), params, ["run", "trial"], path)
    return R.read_trial_log(spark, path, "run string, trial long, score double")


@query("features_sink", f"WITH {BARS} SELECT time, round(CASE WHEN idx >= 5 THEN close / lag(close, 4) OVER {W} - 1 END, 6) AS roc_fast FROM bars QUALIFY instrument = 'view'")
def features_sink(spark, sf_dir):
    """Features written by instrument and month; a reader of one instrument and one feature opens its folders and column alone."""
    path = scratch_path(spark, "features")
    R.write_months(scalping(bars(spark, sf_dir)).select("instrument", "time", "roc_fast", "roc_slow", "mean_rev_z", "atr", "body_ratio"), path)
    return R.candles_dir(spark, path).where("instrument = 'view'").select("time", *rounded("roc_fast"))


@query("ticks_csv", f"WITH {TICKS} SELECT date_trunc('milliseconds', time) AS time, round(bid, 6) AS bid, round(ask, 6) AS ask FROM ticks")
def ticks_csv(spark, sf_dir):
    own = ticks(spark, sf_dir).select(F.unix_millis(F.col("time").cast("timestamp")).cast("string").alias("timestamp"), F.col("bid").alias("bidPrice"), F.col("ask").alias("askPrice"))
    broken = spark.createDataFrame([("x", 1.0, 2.0), (None, 1.0, 1.0)], own.schema)
    return R.quotes_csv(spark, _csv(spark, own.unionByName(broken), "quotes")).select("time", *rounded("bid", "ask"))


@query(
    "rollup_refresh",
    f"""WITH {BARS}, {bars_sql('days', '1 day')}, h AS (SELECT 'hour' AS width, instrument, time, {', '.join(OHLC)}, tick_count FROM bars UNION ALL SELECT 'day', instrument, time, {', '.join(OHLC)}, tick_count FROM days)
    SELECT width, instrument, time, {', '.join(f'round({c}, 6) AS {c}' for c in OHLC)}, tick_count FROM h""",
)
def rollup_refresh(spark, sf_dir):
    """Three loads, each followed by a refresh: most days, some of them broken off; the rest, with the partial days again; corrections of wrong prices."""
    own, day = ticks(spark, sf_dir), F.dayofmonth("time")
    store = RollUps(spark, scratch_path(spark, "store"), complete=0)
    wrong = own.withColumn("mid", F.when(day == 5, -F.col("mid")).otherwise(F.col("mid")))
    store.load(wrong.where((day <= 20) & ((day % 4 != 0) | (F.hour("time") < 9))))
    store.refresh()
    partial = RollUps(spark, store.path)
    partial.load(own.where((day > 20) | (day % 4 == 0)))
    partial.refresh()
    store.load(own.where(day == 5), correct=True)
    store.refresh()
    both = [store.table(n).select(F.lit(w).alias("width"), "instrument", "time", *rounded(*OHLC), "tick_count") for w, n in (("hour", "hours"), ("day", "days"))]
    return both[0].unionByName(both[1])
