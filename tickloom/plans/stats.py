"""Queries: trade statistics, distribution statistics, walk-forward summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import market as M
from tickloom.operators import stats as S
from tickloom.operators.series import with_index
from tickloom.plans.base import BARS, TICKS, TRADES, bars, query, rounded, table, ticks, trades
from tickloom.plans.patterns import W

R = "round({0}, 6) AS {0}"


def _metrics_sql(group: str, source: str) -> str:
    return f"""SELECT {group}, count(*) AS n_trades, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS win_rate, round(coalesce(sum(pnl) FILTER (pnl > 0), 0), 2) AS gross_profit,
      round(coalesce(-sum(pnl) FILTER (pnl < 0), 0), 2) AS gross_loss, round(sum(pnl), 2) AS total_pnl,
      round(CASE WHEN coalesce(-sum(pnl) FILTER (pnl < 0), 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0) ELSE 'inf'::DOUBLE END, 6) AS profit_factor,
      round(coalesce(avg(pnl) FILTER (pnl > 0), 0), 6) AS avg_win, round(coalesce(avg(pnl) FILTER (pnl < 0), 0), 6) AS avg_loss,
      round(coalesce(CASE WHEN count(*) > 1 THEN avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) END, 0), 6) AS sharpe,
      round(coalesce(CASE WHEN count(*) FILTER (pnl < 0) > 1 THEN avg(pnl) / nullif(stddev_samp(pnl) FILTER (pnl < 0), 0) * sqrt(252) END, 0), 6) AS sortino
    FROM {source} GROUP BY {group}"""


def _metrics(df, *group):
    plain = ("win_rate", "profit_factor", "avg_win", "avg_loss", "sharpe", "sortino")
    out = S.trade_metrics(df, *group)
    return out.select(*group, "n_trades", *rounded(*plain), *rounded("gross_profit", "gross_loss", "total_pnl", places=2))


CURVE = f"""{TRADES}, c AS (SELECT *, row_number() OVER w AS n, 100000 + sum(pnl) OVER w AS equity, 100000 + coalesce(sum(pnl) OVER (PARTITION BY account ORDER BY opened_at, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM trades WINDOW w AS (PARTITION BY account ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY account ORDER BY n ROWS UNBOUNDED PRECEDING)) AS peak FROM c)"""


@query(
    "trade_metrics",
    f"""WITH {CURVE}, m AS ({_metrics_sql('account', 'trades')}), dd AS (SELECT account, arg_max((peak - equity) / peak, round(peak - equity, 2) * 1000000 - n) AS share FROM d GROUP BY 1),
    x AS (SELECT account, avg(pnl) AS mean, CASE WHEN count(*) > 1 THEN (avg(pnl) - 25.2 / 252) / nullif(stddev_samp(pnl), 0) * sqrt(252) END AS sharpe_rf FROM trades GROUP BY 1)
    SELECT m.*, round(coalesce(x.mean * 252 / nullif(abs(dd.share), 0), 0), 3) AS calmar, round(coalesce(sharpe_rf, 0), 6) AS sharpe_rf FROM m JOIN dd USING (account) JOIN x USING (account)""",
)
def trade_metrics(spark, sf_dir):
    own = trades(spark, sf_dir)
    with_falls = S.trade_metrics(own, "account", risk_free=25.2, capital=100_000.0)
    return _metrics(own, "account").join(with_falls.select("account", F.round("calmar", 3).alias("calmar"), F.round("sharpe", 6).alias("sharpe_rf")), "account")


@query("metrics_by_source", f"WITH {TRADES}, t AS (SELECT *, CASE WHEN source LIKE '5%' THEN 'ict' ELSE source END AS src FROM trades) {_metrics_sql('src', 't')}")
def metrics_by_source(spark, sf_dir):
    tagged = trades(spark, sf_dir).withColumn("src", F.coalesce(F.when(~F.col("source").startswith("5"), F.col("source")), F.lit("ict")))
    return _metrics(tagged, "src")


@query("max_drawdown", f"WITH {CURVE} SELECT account, round(max(round(peak - equity, 2)), 2) AS max_dd, round(arg_max((peak - equity) / peak, round(peak - equity, 2) * 1000000 - n), 6) AS max_dd_pct FROM d GROUP BY 1")
def max_drawdown(spark, sf_dir):
    return S.drawdown(trades(spark, sf_dir), 100_000.0).select("account", *rounded("max_dd", places=2), *rounded("max_dd_pct"))


@query("max_drawdown_pct", f"WITH {CURVE} SELECT account, round(max((peak - equity) / peak), 6) AS worst_pct FROM d GROUP BY 1")
def max_drawdown_pct(spark, sf_dir):
    return S.drawdown(trades(spark, sf_dir), 100_000.0).select("account", *rounded("worst_pct"))


@query("avg_risk_pct", f"WITH {CURVE} SELECT account, round(avg(entry_price * 0.01 * size * 0.1 / before), 6) AS avg_risk_pct FROM d WHERE before > 0 GROUP BY 1")
def avg_risk_pct(spark, sf_dir):
    curve = S.equity(trades(spark, sf_dir), 100_000.0).where("before > 0")
    risk = F.col("entry_price") * 0.01 * F.col("size") * 0.1 / F.col("before")
    return curve.groupBy("account").agg(F.round(F.avg(risk), 6).alias("avg_risk_pct"))


MONTHS = f"""{TRADES}, m AS (SELECT strftime(opened_at, '%Y-%m') AS win, * FROM trades), wm AS ({_metrics_sql('win', 'm')})"""


@query(
    "wf_aggregate",
    f"WITH {MONTHS} SELECT count(*) AS n_windows, sum(n_trades)::BIGINT AS n_trades, round(avg(win_rate), 5) AS win_rate, round(avg(profit_factor) FILTER (NOT isinf(profit_factor)), 5) AS profit_factor, round(avg(sharpe), 5) AS sharpe, count(*) FILTER (total_pnl > 0) AS profitable FROM wm",
)
def wf_aggregate(spark, sf_dir):
    monthly = _metrics(trades(spark, sf_dir).withColumn("win", F.date_format("opened_at", "yyyy-MM")), "win")
    return monthly.agg(
        F.count("*").alias("n_windows"),
        F.sum("n_trades").alias("n_trades"),
        *[F.round(F.avg(F.when(F.col(c) < float("inf"), F.col(c))), 5).alias(c) for c in ("win_rate", "profit_factor", "sharpe")],
        F.count_if(F.col("total_pnl") > 0).alias("profitable"),
    )


@query(
    "source_breakdown",
    f"""WITH {TRADES}, m AS (SELECT strftime(opened_at, '%Y-%m') AS win, source, count(*) AS n, avg(pnl) AS mean, avg(pnl) FILTER (pnl > 0) AS aw, count(*) FILTER (pnl > 0) AS nw, avg(pnl) FILTER (pnl < 0) AS al, count(*) FILTER (pnl < 0) AS nl FROM trades GROUP BY 1, 2)
    SELECT source, sum(n)::BIGINT AS n, round(sum(mean * n) / sum(n), 4) AS mean, round(sum(aw * nw) / nullif(-sum(al * nl), 0), 6) AS profit_factor FROM m GROUP BY 1""",
)
def source_breakdown(spark, sf_dir):
    won, lost = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    monthly = trades(spark, sf_dir).groupBy(F.date_format("opened_at", "yyyy-MM").alias("win"), "source").agg(
        F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.avg(won).alias("aw"), F.count(won).alias("nw"), F.avg(lost).alias("al"), F.count(lost).alias("nl")
    )
    pooled = F.sum(F.col("aw") * F.col("nw")) / F.nullif(-F.sum(F.col("al") * F.col("nl")), F.lit(0.0))
    return monthly.groupBy("source").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 4).alias("mean"), F.round(pooled, 6).alias("profit_factor")
    )


PARAMS = "params AS (SELECT p_brand AS run, unnest(['size', 'price']) AS param, unnest([p_size::DOUBLE, p_retailprice]) AS value, p_partkey AS trial FROM part)"


def _params(spark, sf_dir):
    """Parts as trials: their size and price are the parameters, the brand is the run."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("run"), F.col("p_partkey").alias("trial"), F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))).alias("param", "value")
    )


@query(
    "param_convergence",
    f"WITH {PARAMS} SELECT run, param, round((max(value) - min(value)) / nullif(abs(avg(value)), 0), 6) AS spread, coalesce((max(value) - min(value)) / nullif(abs(avg(value)), 0) < 0.3, false) AS converged FROM params GROUP BY 1, 2",
)
def param_convergence(spark, sf_dir):
    return S.convergence(_params(spark, sf_dir), "run", "param").withColumn("spread", F.round("spread", 6))


@query(
    "param_stability",
    f"WITH {PARAMS} SELECT run, param, round(coalesce(stddev_pop(value) / nullif(abs(avg(value)), 0) * 100, 0), 6) AS variation, coalesce(stddev_pop(value) / nullif(abs(avg(value)), 0) * 100, 0) < 15 AS stable FROM params GROUP BY 1, 2",
)
def param_stability(spark, sf_dir):
    return S.stability(_params(spark, sf_dir), "run", "param").withColumn("variation", F.round("variation", 6))


@query(
    "range_saturation",
    f"""WITH {PARAMS}, b AS (SELECT param, min(value) AS lo, max(value) AS hi FROM params GROUP BY 1)
    SELECT DISTINCT run, param, CASE WHEN value <= lo + 0.05 * (hi - lo) THEN 'low' ELSE 'high' END AS edge FROM params JOIN b USING (param) WHERE value <= lo + 0.05 * (hi - lo) OR value >= hi - 0.05 * (hi - lo)""",
)
def range_saturation(spark, sf_dir):
    own = _params(spark, sf_dir)
    bounds = own.groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return S.saturation(own, bounds, 0.05).select("run", "param", "edge").distinct()


@query(
    "median_topn",
    f"WITH {PARAMS}, t AS (SELECT *, row_number() OVER (PARTITION BY run, param ORDER BY trial % 97 DESC, trial) AS n FROM params) SELECT run, param, round(median(value), 6) AS value FROM t WHERE n <= 5 GROUP BY 1, 2",
)
def median_topn(spark, sf_dir):
    scored = _params(spark, sf_dir).withColumn("score", F.col("trial") % 97)
    return S.median_of_best(scored, ["run", "param"], "score", "trial", 5).withColumn("value", F.round("value", 6))


@query("param_keys", f"WITH {PARAMS} SELECT DISTINCT param AS key FROM params")
def param_keys(spark, sf_dir):
    own = _params(spark, sf_dir).groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("params"))
    return own.select(F.explode(F.map_keys("params")).alias("key")).distinct()


@query(
    "top_trials",
    f"""WITH {TRADES}, s AS (SELECT account, count(*) AS n, sum(pnl) AS total, round(coalesce(sum(pnl) / 100000 * avg(pnl) / nullif(stddev_samp(pnl), 0) * count(*), 0), 6) AS score FROM trades GROUP BY 1)
    SELECT account, n, score, row_number() OVER (ORDER BY score DESC, account) AS place FROM s WHERE score > -10 QUALIFY place <= 20""",
)
def top_trials(spark, sf_dir):
    score = F.sum("pnl") / 100_000 * F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * F.count("*")
    own = trades(spark, sf_dir).groupBy("account").agg(F.count("*").alias("n"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))
    best = own.where("score > -10").orderBy(F.desc("score"), "account").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "account")).cast("long"))


NORM = f"""{BARS}, o AS (SELECT instrument, close / lag(close) OVER {W} - 1 AS ret, tick_count::DOUBLE AS tick_count, spread FROM bars),
  u AS (SELECT 'ret' AS col, ret AS v FROM o UNION ALL SELECT 'tick_count', tick_count FROM o UNION ALL SELECT 'spread', spread FROM o)"""


@query("norm_stats", f"WITH {NORM} SELECT col, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END, 6) AS std FROM u GROUP BY 1")
def norm_stats(spark, sf_dir):
    from tickloom.operators.rolling import returns

    own = returns(bars(spark, sf_dir)).withColumn("tick_count", F.col("tick_count").cast("double"))
    return S.normalization(own, ["ret", "tick_count", "spread"]).select("col", *rounded("mean", "std"))


@query(
    "hourly_vol",
    f"""WITH {BARS}, o AS (SELECT hour(time) AS hour, abs(close / lag(close) OVER {W} - 1) AS r FROM bars), g AS (SELECT hour, avg(r) AS v FROM o GROUP BY 1)
    SELECT h.hour::BIGINT AS hour, round(v, 6) AS vol FROM range(24) h(hour) LEFT JOIN g ON g.hour = h.hour""",
)
def hourly_vol(spark, sf_dir):
    from tickloom.operators.rolling import returns

    return S.hourly(returns(bars(spark, sf_dir))).withColumn("vol", F.round("vol", 6))


@query(
    "ks_2samp",
    """WITH a AS (SELECT value AS v FROM events WHERE event_type = 'view'), b AS (SELECT value AS v FROM events WHERE event_type = 'click'),
    u AS (SELECT v, 1.0 / (SELECT count(*) FROM a) AS fa, 0.0 AS fb FROM a UNION ALL SELECT v, 0.0, 1.0 / (SELECT count(*) FROM b) FROM b),
    s AS (SELECT v, count(*) FILTER (fa > 0) AS na, count(*) FILTER (fb > 0) AS nb FROM u GROUP BY v),
    c AS (SELECT abs(sum(na) OVER o / (SELECT count(*) FROM a)::DOUBLE - sum(nb) OVER o / (SELECT count(*) FROM b)::DOUBLE) AS d FROM s WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT (SELECT count(*) FROM a)::DOUBLE AS n_a, (SELECT count(*) FROM b)::DOUBLE AS n_b, max(d) AS d FROM c), l AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) AS r FROM k)
    SELECT n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, round(d, 6) AS d, round(CASE WHEN d = 0 THEN 1 ELSE least(greatest((SELECT sum((CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * j * j * pow((r + 0.12 + 0.11 / r) * d, 2))) FROM range(1, 101) t(j)), 0), 1) END, 6) AS p FROM l""",
)
def ks_2samp(spark, sf_dir):
    own = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    both = S.two_sample(own, F.col("event_type") == "view", "value")
    return both.withColumn("p", F.round(S.smirnov_p(F.col("d"), F.col("n_a"), F.col("n_b")), 6)).withColumn("d", F.round("d", 6)).select("n_a", "n_b", "d", "p")


def _acf_sql(value: str) -> str:
    return f"""WITH {BARS}, o AS (SELECT instrument, idx, {value} AS x FROM bars), c AS (SELECT instrument, idx, x - avg(x) OVER (PARTITION BY instrument) AS d FROM o WHERE x IS NOT NULL),
    p AS (SELECT a.instrument, l.lag::BIGINT AS lag, sum(a.d * b.d) AS s FROM c a CROSS JOIN range(1, 11) l(lag) JOIN c b ON b.instrument = a.instrument AND b.idx = a.idx - l.lag GROUP BY 1, 2),
    v AS (SELECT instrument, sum(d * d) AS s FROM c GROUP BY 1) SELECT p.instrument, lag, round(coalesce(p.s / nullif(v.s, 0), 0), 6) AS acf FROM p JOIN v USING (instrument)"""


RET = f"close / lag(close) OVER {W} - 1"


@query("acf", _acf_sql(RET))
def acf(spark, sf_dir):
    from tickloom.operators.rolling import returns

    return S.autocorrelation(returns(bars(spark, sf_dir)), "ret", 10).withColumn("acf", F.round("acf", 6))


@query("acf_sq", _acf_sql(f"({RET}) * ({RET})"))
def acf_sq(spark, sf_dir):
    from tickloom.operators.rolling import returns

    squared = returns(bars(spark, sf_dir)).withColumn("sq", F.col("ret") * F.col("ret"))
    return S.autocorrelation(squared, "sq", 10).withColumn("acf", F.round("acf", 6))


@query(
    "validation_report",
    f"""WITH {BARS}, o AS (SELECT instrument, idx, hour(time) AS hour, {RET} AS r FROM bars), k AS (SELECT * FROM o WHERE r IS NOT NULL AND instrument IN ('view', 'click')),
    x AS (SELECT 'acf' AS metric, instrument, idx, r AS x FROM k UNION ALL SELECT 'acf_sq', instrument, idx, r * r FROM k), c AS (SELECT metric, instrument, idx, x - avg(x) OVER (PARTITION BY metric, instrument) AS d FROM x),
    p AS (SELECT a.metric, a.instrument, l.lag, sum(a.d * b.d) AS s FROM c a CROSS JOIN range(1, 11) l(lag) JOIN c b ON b.metric = a.metric AND b.instrument = a.instrument AND b.idx = a.idx - l.lag GROUP BY ALL),
    v AS (SELECT metric, instrument, sum(d * d) AS s FROM c GROUP BY ALL), q AS (SELECT metric, instrument, lag, p.s / v.s AS a FROM p JOIN v USING (metric, instrument)),
    h AS (SELECT instrument, hour, avg(abs(r)) AS a FROM k GROUP BY ALL),
    e AS (SELECT *, abs((count(*) FILTER (instrument = 'view') OVER w) / (count(*) FILTER (instrument = 'view') OVER ())::DOUBLE - (count(*) FILTER (instrument = 'click') OVER w) / (count(*) FILTER (instrument = 'click') OVER ())::DOUBLE) AS d FROM k WINDOW w AS (ORDER BY r)),
    g AS (SELECT max(d) AS d, count(*) FILTER (instrument = 'view') AS n, count(*) FILTER (instrument = 'click') AS m FROM e), z AS (SELECT d, (sqrt(n * m / (n + m)::DOUBLE) + 0.12 + 0.11 / sqrt(n * m / (n + m)::DOUBLE)) * d AS t FROM g),
    out AS (SELECT 'ks' AS metric, d AS value FROM z UNION ALL SELECT 'ks_p', CASE WHEN d = 0 THEN 1 ELSE least(greatest((SELECT sum((CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * j * j * t * t)) FROM range(1, 101) u(j)), 0), 1) END FROM z
      UNION ALL SELECT a.metric || '_max_diff', max(abs(a.a - b.a)) FROM q a JOIN q b ON b.metric = a.metric AND b.lag = a.lag AND a.instrument = 'view' AND b.instrument = 'click' GROUP BY 1
      UNION ALL SELECT 'hourly_max_diff', max(abs(a.a - b.a)) FROM h a JOIN h b ON b.hour = a.hour AND a.instrument = 'view' AND b.instrument = 'click')
    SELECT metric, round(value, 6) AS value FROM out""",
)
def validation_report(spark, sf_dir):
    """The returns of one instrument held against those of another, as drawn paths are held against real ones."""
    from tickloom.operators.rolling import returns

    return S.compare_returns(returns(bars(spark, sf_dir)), "view", "click").withColumn("value", F.round("value", 6))


@query("trading_days_distinct", "SELECT event_type, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def trading_days_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct(F.to_date("ts")).alias("days"))


@query("tick_stats", f"WITH {TICKS} SELECT instrument, min(time) AS first_time, max(time) AS last_time, count(*) AS n FROM ticks GROUP BY 1")
def tick_stats(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("instrument").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("n"))


@query(
    "loser_summary",
    f"""WITH {TRADES}, l AS (SELECT source, trade_id, pnl, row_number() OVER (PARTITION BY source ORDER BY pnl, trade_id) AS n FROM trades WHERE pnl < 0)
    SELECT t.source, count(*) FILTER (t.pnl > 0) AS winners, count(*) FILTER (t.pnl < 0) AS losers, round(sum(t.pnl), 2) AS total,
    coalesce((SELECT string_agg(l.trade_id::VARCHAR, ',' ORDER BY l.n) FROM l WHERE l.source = t.source AND l.n <= 10), '') AS worst FROM trades t GROUP BY 1""",
)
def loser_summary(spark, sf_dir):
    own = trades(spark, sf_dir)
    worst = own.where("pnl < 0").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("pnl", "trade_id"))).where("n <= 10")
    listed = worst.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "trade_id"))), lambda x: x["trade_id"].cast("string")), ",").alias("worst"))
    counts = own.groupBy("source").agg(F.count_if(F.col("pnl") > 0).alias("winners"), F.count_if(F.col("pnl") < 0).alias("losers"), F.round(F.sum("pnl"), 2).alias("total"))
    return counts.join(listed, "source", "left").withColumn("worst", F.coalesce("worst", F.lit("")))


@query(
    "portfolio_equity",
    f"WITH {TRADES} SELECT account, round(sum(CASE WHEN trade_id % 2 = 0 THEN 1 ELSE -1 END * size), 2) AS net_size, round(sum(CASE WHEN trade_id % 2 = 0 THEN pnl ELSE -pnl END), 2) AS unrealized, round(100000 + sum(pnl), 2) AS equity FROM trades GROUP BY 1",
)
def portfolio_equity(spark, sf_dir):
    long = F.col("trade_id") % 2 == 0
    return trades(spark, sf_dir).groupBy("account").agg(
        F.round(F.sum(F.when(long, 1).otherwise(-1) * F.col("size")), 2).alias("net_size"),
        F.round(F.sum(F.when(long, F.col("pnl")).otherwise(-F.col("pnl"))), 2).alias("unrealized"),
        F.round(F.sum("pnl") + 100_000, 2).alias("equity"),
    )


EDGES = (-10000, -5000, -1000, 0, 1000, 5000, 10000)


@query(
    "pnl_histogram",
    f"WITH {TRADES}, e AS (SELECT unnest([{', '.join(map(str, EDGES))}])::BIGINT AS edge) SELECT source, edge AS le, count(*) FILTER (pnl <= edge) AS n FROM trades CROSS JOIN e GROUP BY 1, 2",
)
def pnl_histogram(spark, sf_dir):
    counts = [F.count_if(F.col("pnl") <= e).alias(str(e)) for e in EDGES]
    wide = trades(spark, sf_dir).groupBy("source").agg(*counts)
    pairs = F.array(*[F.struct(F.lit(e).cast("long").alias("le"), F.col(f"`{e}`").alias("n")) for e in EDGES])
    return wide.select("source", F.inline(pairs))


@query(
    "report_summary",
    f"WITH {TRADES}, m AS ({_metrics_sql('account', 'trades')}) SELECT account, n_trades, round(win_rate * 100, 1) AS win_rate_pct, round(total_pnl, 2) AS total_pnl, round(avg_win::DECIMAL(28, 8), 4)::DOUBLE AS avg_win, round(avg_loss::DECIMAL(28, 8), 4)::DOUBLE AS avg_loss FROM m",
)
def report_summary(spark, sf_dir):
    own = _metrics(trades(spark, sf_dir), "account")
    money = [F.round(F.col(c).cast("decimal(28,8)"), 4).cast("double").alias(c) for c in ("avg_win", "avg_loss")]
    return own.select("account", "n_trades", F.round(F.col("win_rate") * 100, 1).alias("win_rate_pct"), "total_pnl", *money)


@query(
    "circuit_breaker",
    f"""WITH {TRADES}, d AS (SELECT account, opened_at::DATE AS day, trade_id, pnl, sum(pnl) OVER (PARTITION BY account, opened_at::DATE ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING) AS day_pnl,
      sum(pnl) OVER (PARTITION BY account ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING) AS total_pnl FROM trades)
    SELECT account, trade_id, round(day_pnl, 2) AS day_pnl, CASE WHEN round(day_pnl, 2) <= -3000 THEN 'daily_drawdown' WHEN round(day_pnl, 2) >= 5000 THEN 'daily_gain' WHEN round(total_pnl, 2) <= -10000 THEN 'total_drawdown' ELSE 'none' END AS breaker FROM d""",
)
def circuit_breaker(spark, sf_dir):
    order = ("opened_at", "trade_id")
    by_day = Window.partitionBy("account", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    overall = Window.partitionBy("account").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = trades(spark, sf_dir).withColumn("day", F.to_date("opened_at"))
    summed = own.withColumns({"day_pnl": F.round(F.sum("pnl").over(by_day), 2), "total": F.round(F.sum("pnl").over(overall), 2)})
    breaker = F.when(F.col("day_pnl") <= -3000, "daily_drawdown").when(F.col("day_pnl") >= 5000, "daily_gain").when(F.col("total") <= -10000, "total_drawdown")
    return summed.select("account", "trade_id", "day_pnl", breaker.otherwise("none").alias("breaker"))


@query("recent_trades", f"WITH {TRADES} SELECT trade_id, opened_at, pnl FROM trades ORDER BY opened_at DESC, trade_id DESC LIMIT 50")
def recent_trades(spark, sf_dir):
    return trades(spark, sf_dir).orderBy(F.desc("opened_at"), F.desc("trade_id")).limit(50).select("trade_id", "opened_at", "pnl")


@query(
    "mc_returns",
    f"""WITH {BARS}, r AS (SELECT instrument, idx // 16 AS path, idx % 16 AS step, coalesce({RET}, 0) AS ret FROM bars)
    SELECT a.instrument, a.path::BIGINT AS path, a.step::BIGINT AS step, round(sum(b.ret * pow(0.9, b.step - a.step)), 6) AS value FROM r a JOIN r b ON a.instrument = b.instrument AND a.path = b.path AND b.step >= a.step GROUP BY 1, 2, 3""",
)
def mc_returns(spark, sf_dir):
    from tickloom.operators.rolling import returns

    own = returns(bars(spark, sf_dir)).select("instrument", F.floor(F.col("idx") / 16).alias("path"), (F.col("idx") % 16).alias("step"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return S.discounted(own, ["instrument", "path"], "step", "ret", 0.9).withColumn("value", F.round("value", 6))


@query("symlog", f"WITH {TRADES} SELECT trade_id, round(sign(pnl) * ln(1 + abs(pnl)), 6) AS symlog, round(sign(pnl) * (exp(ln(1 + abs(pnl))) - 1), 2) AS back FROM trades")
def symlog(spark, sf_dir):
    forward = F.signum("pnl") * F.log1p(F.abs("pnl"))
    own = trades(spark, sf_dir).select("trade_id", forward.alias("f"))
    return own.select("trade_id", F.round("f", 6).alias("symlog"), F.round(F.signum("f") * F.expm1(F.abs("f")), 2).alias("back"))


@query(
    "portfolio_features",
    f"""WITH {TRADES}, c AS (SELECT *, row_number() OVER w AS n, (100000 + sum(pnl::DECIMAL(18, 2)) OVER w)::DOUBLE AS capital FROM trades WINDOW w AS (PARTITION BY account ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING))
    SELECT trade_id, (trade_id % 3 = 0)::INT::DOUBLE AS is_flat, (trade_id % 3 = 1)::INT::DOUBLE AS is_long, (trade_id % 3 = 2)::INT::DOUBLE AS is_short, round(pnl / 100000, 10) AS pnl_norm, round(n / 64.0::DOUBLE, 10) AS time_norm,
      round(capital / 100000, 10) AS cap_norm, round(entry_price * 0.05 / 100000, 10) AS margin_norm FROM c""",
)
def portfolio_features(spark, sf_dir):
    own = S.equity(trades(spark, sf_dir).withColumn("pnl", F.col("pnl").cast("decimal(18,2)")), 100_000.0)
    features = M.portfolio_vector(F.col("trade_id") % 3, F.col("pnl").cast("double"), F.col("n").cast("double"), F.col("equity").cast("double"), F.col("entry_price") * 0.05, 100_000.0, 64)
    return own.select("trade_id", *[(F.round(c, 10) if n.endswith("norm") else c).alias(n) for n, c in features.items()])


WF_DAYS = ("1992-01-01", 360, 90, 90)


@query(
    "walk_forward",
    f"""WITH {TRADES}, t AS (SELECT account % 16 AS trial, trade_id, opened_at, pnl, date_diff('day', DATE '1992-01-01', opened_at::DATE) AS day FROM trades),
    w AS (SELECT k.k::BIGINT AS "window", CASE WHEN day - k.k * 90 < 360 THEN 'train' ELSE 'test' END AS phase, t.* FROM t, range(0, 40) k(k) WHERE day >= k.k * 90 AND day < k.k * 90 + 450),
    eq AS (SELECT *, 100000 + sum(pnl) OVER o AS equity, row_number() OVER o AS nth FROM w WINDOW o AS (PARTITION BY "window", phase, trial ORDER BY opened_at, trade_id ROWS UNBOUNDED PRECEDING)),
    pk AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY "window", phase, trial ORDER BY nth ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
    m AS (SELECT "window", phase, trial, count(*) AS n, sum(pnl) AS total, avg(pnl) AS mean, stddev_samp(pnl) AS dev, count(*) FILTER (pnl > 0) AS won, arg_max((peak - equity) / peak, round(peak - equity, 2) * 1000000 - nth) AS fall,
      coalesce(sum(pnl) FILTER (pnl > 0), 0) < coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS losing FROM pk GROUP BY 1, 2, 3),
    s AS (SELECT *, round(CASE WHEN n < 5 OR fall > 0.5 OR losing OR mean < 0 THEN -10 ELSE total / 100000 * coalesce(mean / nullif(dev, 0) * sqrt(252), 0) * n END, 6) AS score FROM m WHERE phase = 'train'),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY score DESC, trial) = 1)
    SELECT b."window", b.trial, round(b.score, 4) AS score, b.n AS n_train, m.n AS n_trades, round(m.won / m.n::DOUBLE, 6) AS win_rate, round(m.total, 2) AS total_pnl, round(CASE WHEN m.n IS NOT NULL THEN coalesce(m.mean / nullif(m.dev, 0) * sqrt(252), 0) END, 6) AS sharpe
    FROM b LEFT JOIN m ON m."window" = b."window" AND m.trial = b.trial AND m.phase = 'test'""",
)
def walk_forward(spark, sf_dir):
    """Accounts in sixteen groups as trials: in each window the best of the training year is held against the next quarter."""
    own = trades(spark, sf_dir).withColumn("trial", F.col("account") % 16)
    out = S.walk_forward(own, *WF_DAYS)
    return out.select("window", "trial", F.round("score", 4).alias("score"), "n_train", "n_trades", *rounded("win_rate", "sharpe"), *rounded("total_pnl", places=2))


@query(
    "news_ablation",
    f"""WITH {TRADES}, m AS (SELECT CASE WHEN source LIKE '1%' THEN 'news' ELSE 'rest' END AS kind, pnl FROM trades), a AS (SELECT 'with' AS arm, pnl FROM m UNION ALL SELECT 'without', pnl FROM m WHERE kind <> 'news')
    SELECT arm, count(*) AS n_trades, round(sum(pnl), 2) AS total_pnl, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS win_rate FROM a GROUP BY 1""",
)
def news_ablation(spark, sf_dir):
    """The metrics of all trades beside those of the trades that no news had set off."""
    own = trades(spark, sf_dir)
    arms = own.withColumn("arm", F.explode(F.when(F.col("source").startswith("1"), F.array(F.lit("with"))).otherwise(F.array(F.lit("with"), F.lit("without")))))
    return S.trade_metrics(arms, "arm").select("arm", "n_trades", F.round("total_pnl", 2).alias("total_pnl"), *rounded("win_rate"))
