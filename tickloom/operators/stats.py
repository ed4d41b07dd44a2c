"""Statistics of trades, parameters and return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.scratch import stored

ORDER = ("opened_at", "trade_id")
#: Rows of one task of ``walk_forward``, about.
TASK_ROWS = 250_000


def trade_metrics(trades: DataFrame, *group: str, risk_free: float = 0.0, capital: float | None = None) -> DataFrame:
    """Counts, win rate, profit factor (infinite without losers), and per-trade ratios annualised by the root of 252.

    ``risk_free`` is a yearly amount taken off each trade's share of the year. With ``capital`` the trades' largest
    drawdown and the Calmar ratio are added; trades are then put in order of opening within each group.
    """
    pnl = F.col("pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    zero = F.lit(0.0)
    profit, loss = F.coalesce(F.sum(won), zero), F.coalesce(-F.sum(lost), zero)
    year = 252**0.5
    excess = F.avg(pnl) - risk_free / 252
    sharpe = F.when(F.count("*") > 1, excess / F.nullif(F.stddev_samp(pnl), zero) * year)
    sortino = F.when(F.count(lost) > 1, excess / F.nullif(F.stddev_samp(lost), zero) * year)
    out = trades.groupBy(*group).agg(
        F.count("*").alias("n_trades"),
        (F.count(won) / F.count("*")).alias("win_rate"),
        profit.alias("gross_profit"),
        loss.alias("gross_loss"),
        F.sum(pnl).alias("total_pnl"),
        F.when(loss > 0, profit / loss).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.coalesce(F.avg(won), zero).alias("avg_win"),
        F.coalesce(F.avg(lost), zero).alias("avg_loss"),
        F.coalesce(sharpe, zero).alias("sharpe"),
        F.coalesce(sortino, zero).alias("sortino"),
    )
    if capital is None:
        return out
    falls = drawdown(trades.select(*group, *ORDER, "pnl"), capital, *group).select(*group, "max_dd", "max_dd_pct")
    calmar = F.coalesce(F.col("total_pnl") / F.col("n_trades") * 252 / F.nullif(F.abs("max_dd_pct"), zero), zero)
    return out.join(falls, list(group)).withColumn("calmar", calmar)


def equity(trades: DataFrame, capital: float, *group: str) -> DataFrame:
    """``n``, ``equity`` after and ``before`` each trade of an account, in order of opening."""
    window = Window.partitionBy(*(group or ("account",))).orderBy(*ORDER)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    gained = trades.withColumns({"n": F.row_number().over(window), "equity": F.sum("pnl").over(upto) + F.lit(capital)})
    return gained.withColumn("before", F.col("equity") - F.col("pnl"))


def peaks(curve: DataFrame, capital: float, *group: str) -> DataFrame:
    upto = Window.partitionBy(*(group or ("account",))).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(upto)))


def drawdown(trades: DataFrame, capital: float, *group: str) -> DataFrame:
    """Largest absolute drawdown, its share of the peak at that trade (first on ties), and the largest share."""
    group = group or ("account",)
    curve = peaks(equity(trades, capital, *group), capital, *group)
    fall = F.round(F.col("peak") - F.col("equity"), 2)
    share = (F.col("peak") - F.col("equity")) / F.col("peak")
    return curve.groupBy(*group).agg(
        F.max(fall).alias("max_dd"), F.max_by(share, F.struct(fall, -F.col("n"))).alias("max_dd_pct"), F.max(share).alias("worst_pct")
    )


def convergence(params: DataFrame, *group: str) -> DataFrame:
    """Range of a parameter over its mean; converged below 0.3."""
    spread = (F.max("value") - F.min("value")) / F.nullif(F.abs(F.avg("value")), F.lit(0.0))
    return params.groupBy(*group).agg(spread.alias("spread")).withColumn("converged", F.coalesce(F.col("spread") < 0.3, F.lit(False)))


def stability(params: DataFrame, *group: str) -> DataFrame:
    """Coefficient of variation in percent; stable below 15."""
    variation = F.coalesce(F.stddev_pop("value") / F.nullif(F.abs(F.avg("value")), F.lit(0.0)) * 100, F.lit(0.0))
    return params.groupBy(*group).agg(variation.alias("variation")).withColumn("stable", F.col("variation") < 15)


def saturation(params: DataFrame, bounds: DataFrame, share: float) -> DataFrame:
    """Values within ``share`` of the width of their range from one of its ends."""
    margin = (F.col("hi") - F.col("lo")) * share
    low, high = F.col("value") <= F.col("lo") + margin, F.col("value") >= F.col("hi") - margin
    return params.join(bounds, "param").where(low | high).withColumn("edge", F.when(low, "low").otherwise("high"))


def median_of_best(params: DataFrame, group: list[str], score: str, tie: str, n: int) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    kept = params.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= n)
    return kept.groupBy(*group).agg(F.median("value").alias("value"))


def commonest_of_best(params: DataFrame, group: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The commonest value among the best ``n`` rows of each group; of values as common, that of the better row."""
    best = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    kept = params.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= n)
    counts = kept.groupBy(*group, "value").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    return counts.groupBy(*group).agg(F.max_by("value", F.struct("_n", -F.col("_first"))).alias("value"))


def normalization(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column; a deviation under 1e-8 counts as 1. One pass over the data."""
    wide = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std")) for c in columns])
    return wide.select(F.inline(rows)).withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def hourly(returns: DataFrame) -> DataFrame:
    """Mean absolute return of each hour of the day; null where there is none."""
    own = returns.groupBy(F.hour("time").cast("long").alias("hour")).agg(F.avg(F.abs("ret")).alias("vol"))
    return returns.sparkSession.range(24).withColumnRenamed("id", "hour").join(own, "hour", "left")


def two_sample(df: DataFrame, in_first: Column, value: str, bins: int = 4096) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples.

    Values are dealt into ranges, so each running count is a range's own plus that of the ranges before it,
    and no task orders a whole sample.
    """
    own = df.select(F.col(value).alias("v"), in_first.alias("a")).where(F.col("v").isNotNull())
    steps = own.groupBy("v").agg(F.count_if("a").alias("na"), F.count_if(~F.col("a")).alias("nb"))
    ends = own.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if("a").alias("n_a"), F.count_if(~F.col("a")).alias("n_b"))
    dealt = steps.crossJoin(F.broadcast(ends)).withColumn(
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    )
    sums = dealt.groupBy("bin").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("sa", "sb")])
    within = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumns({"ca": F.sum("na").over(within), "cb": F.sum("nb").over(within)}).join(F.broadcast(carry), "bin")
    gap = F.abs((F.col("ca") + F.col("sa")) / F.col("n_a") - (F.col("cb") + F.col("sb")) / F.col("n_b"))
    return counted.agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap).alias("d"))


def smirnov_p(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided probability of a distance ``d`` between samples of these sizes."""
    root = F.sqrt(n_a * n_b / (n_a + n_b))
    scaled = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * scaled * scaled))
    return F.when(d == 0, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def autocorrelation(series: DataFrame, value: str, lags: int) -> DataFrame:
    """Biased autocorrelation at lags 1 to ``lags`` of each instrument; 0 for a constant series."""
    from tickloom.operators.series import bounded

    means = series.groupBy("instrument").agg(F.avg(value).alias("_mean"))
    centred = series.join(means, "instrument").withColumn("_d", F.col(value) - F.col("_mean")).where(F.col("_d").isNotNull())
    shifted = bounded(centred, lambda w: {f"_l{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)}, back=lags)
    wide = shifted.groupBy("instrument").agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(f"_l{k}").alias(f"_s{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.coalesce(F.col(f"_s{k}") / F.nullif(F.col("_v"), F.lit(0.0)), F.lit(0.0)).alias("acf")) for k in range(1, lags + 1)])
    return wide.where(F.col("_s1").isNotNull()).select("instrument", F.inline(rows))


def compare_returns(returns: DataFrame, real: str, other: str, lags: int = 10) -> DataFrame:
    """metric and value: how far the returns of one instrument are from those of another in distribution, in memory and by hour.

    ``ks`` and its probability ``ks_p``; the greatest difference of the autocorrelations of returns and of their squares,
    and of the mean absolute returns of an hour, hours that only one of them has left out. ``returns``: instrument, idx,
    time, ret.
    """
    own = stored(returns.where(F.col("instrument").isin(real, other) & F.col("ret").isNotNull()).select("instrument", "idx", "time", "ret", (F.col("ret") * F.col("ret")).alias("sq")), "compared")

    def apart(df: DataFrame, at: str, value: str, name: str) -> DataFrame:
        sides = [F.max(F.when(F.col("instrument") == n, F.col(value))) for n in (real, other)]
        return df.groupBy(at).agg((sides[0] - sides[1]).alias("d")).agg(F.max(F.abs("d")).alias("value")).select(F.lit(name).alias("metric"), "value")

    ks = two_sample(own, F.col("instrument") == real, "ret")
    told = {"ks": F.col("d"), "ks_p": smirnov_p(F.col("d"), F.col("n_a"), F.col("n_b"))}
    ks = ks.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in told.items()])))
    hours = own.groupBy("instrument", F.hour("time").alias("hour")).agg(F.avg(F.abs("ret")).alias("vol"))
    parts = [apart(autocorrelation(own, c, lags), "lag", "acf", f"{n}_max_diff") for c, n in (("ret", "acf"), ("sq", "acf_sq"))]
    return ks.unionByName(parts[0]).unionByName(parts[1]).unionByName(apart(hours, "hour", "vol", "hourly_max_diff"))


def discounted(paths: DataFrame, group: list[str], step: str, value: str, gamma: float) -> DataFrame:
    """Each step's value plus the discounted values of the steps after it, within one path."""
    own = paths.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(step, value))).alias("_steps"))
    start = F.struct(F.lit(0.0).alias("ahead"), F.array().cast(f"array<struct<{step}:bigint,value:double>>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        total = s[value] + acc["ahead"] * gamma
        return F.struct(total.alias("ahead"), F.concat(acc["out"], F.array(F.struct(s[step].alias(step), total.alias("value")))).alias("out"))

    return own.select(*group, F.inline(F.aggregate(F.reverse("_steps"), start, add, lambda acc: acc["out"])))


def trial_score(capital: float, least_trades: int, worst_share: float) -> Column:
    """Profit over capital times Sharpe ratio times trades, from the columns of ``trade_metrics`` with a capital.

    -10 for trials of too few trades, of a deeper drawdown than ``worst_share``, with a profit factor below 1 or a
    negative Sharpe ratio.
    """
    bad = (F.col("n_trades") < least_trades) | (F.col("max_dd_pct") > worst_share) | (F.col("profit_factor") < 1) | (F.col("sharpe") < 0)
    return F.when(bad, -10.0).otherwise(F.col("total_pnl") / capital * F.col("sharpe") * F.col("n_trades"))


def balanced_score() -> Column:
    """Profit, raised by the Sharpe ratio and by the profit factor (at most 5 of it), from the columns of ``trade_metrics``."""
    return F.col("total_pnl") * (1 + F.col("sharpe")) * (1 + 0.2 * F.least(F.col("profit_factor"), F.lit(5.0)))


def in_windows(trades: DataFrame, start: str, train: int, test: int, step: int) -> DataFrame:
    """Each trade once for every walk-forward window it falls into, with ``window`` and ``phase`` (train or test).

    Windows begin every ``step`` days from ``start`` on; the numbers of a trade's windows follow from its day, so no
    table of windows is joined.
    """
    day = F.datediff(F.to_date("opened_at"), F.lit(start).cast("date"))
    first = F.greatest(F.lit(0), F.ceil((day - (train + test) + 1) / step)).cast("int")
    dated = trades.withColumn("_day", day).where("_day >= 0").withColumn("_last", F.floor(F.col("_day") / step).cast("int")).withColumn("_first", first)
    spread = dated.where("_first <= _last").withColumn("window", F.explode(F.sequence(F.col("_first").cast("long"), F.col("_last").cast("long"))))
    phase = F.when(F.col("_day") - F.col("window") * step < train, "train").otherwise("test")
    return spread.withColumn("phase", phase).drop("_day", "_first", "_last")


def walk_forward(trades: DataFrame, start: str, train: int, test: int, step: int, capital: float = 100_000.0, least_trades: int = 5, worst_share: float = 0.5) -> DataFrame:
    """For each window the trial that scores best on its training part (``trial_score``), with the metrics of its test part.

    ``trades`` has trial, opened_at, trade_id and pnl; ties go to the smaller trial. Each trade goes into several windows,
    so only these columns are copied, and there are as many tasks as their rows ask for.
    """
    own = stored(trades.select("trial", *ORDER, "pnl"), "walked-trades")
    tasks = own.count() * -(-(train + test) // step) // TASK_ROWS + 1
    spread = in_windows(own, start, train, test, step).repartition(tasks, "window", "phase", "trial")
    metrics = stored(trade_metrics(spread, "window", "phase", "trial", capital=capital), "walked-metrics")
    tried = metrics.where("phase = 'train'").withColumn("score", F.round(trial_score(capital, least_trades, worst_share), 6))
    best = tried.groupBy("window").agg(F.max_by(F.struct("trial", "score", F.col("n_trades").alias("n_train")), F.struct("score", -F.col("trial"))).alias("b")).select("window", "b.*")
    return best.join(metrics.where("phase = 'test'").drop("phase"), ["window", "trial"], "left")
