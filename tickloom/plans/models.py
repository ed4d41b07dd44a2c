"""Queries: feature tables, models and parameter search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import labels as L
from tickloom.operators.asof import asof_join
from tickloom.operators.rolling import scalping
from tickloom.plans.base import bars, query, rounded
from tickloom.plans.joins import TIMEOUT, _fixed, _rows, _target, exit_dataset
from tickloom.sources.scratch import scratch_path, stored

COLUMNS = ("roc_fast", "roc_slow", "mean_rev_z", "atr", "body_ratio")


def labelled(spark, sf_dir):
    """Tick rows with their barrier labels and the features of the last closed bar."""
    rows = _rows(spark, sf_dir).select("instrument", "time", "idx")
    labels = _fixed(spark, sf_dir).select("instrument", "idx", _target().alias("target"))
    features = scalping(bars(spark, sf_dir)).select("instrument", "time", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COLUMNS])
    return asof_join(rows, features, ["instrument"], COLUMNS, "1 hour").join(labels, ["instrument", "idx"]).na.fill(0.0, list(COLUMNS))


@query("model_signals")
def model_signals(spark, sf_dir):
    from tickloom.ml.search import score_entry, train_entry

    own = labelled(spark, sf_dir).withColumn("hour", F.hour("time").cast("double"))
    names = [*COLUMNS, "hour"]
    model = train_entry(own.where(F.col("idx") % 5 != 0), names, trees=10)
    return score_entry(model, own.where(F.col("idx") % 5 == 0), 0.4).select("instrument", "idx", "target", "signal", *rounded("p_buy", "p_sell"))


@query("param_search")
def param_search(spark, sf_dir):
    from tickloom.ml.search import trials

    drawn = trials(spark, {"stop": (5.0, 60.0), "target": (5.0, 60.0)}, 32)
    moves = bars(spark, sf_dir).select("instrument", (F.col("high") - F.col("open")).alias("up"), (F.col("open") - F.col("low")).alias("down"), (F.col("close") - F.col("open")).alias("drift"))
    each = moves.crossJoin(F.broadcast(drawn))
    pnl = F.when(F.col("down") >= F.col("stop"), -F.col("stop")).when(F.col("up") >= F.col("target"), F.col("target")).otherwise(F.col("drift"))
    return each.groupBy("trial", "stop", "target").agg(F.round(F.sum(pnl), 6).alias("pnl"), F.count("*").alias("n"))


@query("exit_model")
def exit_model(spark, sf_dir):
    """Every row of the exit set, scored by a model of the entries that are not held out, stored and loaded again."""
    from tickloom.ml.search import load_model, save_model, score_exit, train_exit

    own = stored(exit_dataset(spark, sf_dir).withColumn("held_out", F.col("entry_index") % 5 == 0), "exits")
    path = scratch_path(spark, "exit-model")
    save_model(train_exit(own.where(~F.col("held_out")), ["direction", "unrealized", "duration"], rounds=5, depth=3), path)
    scored = score_exit(load_model(path), own, 0.5)
    return scored.select("instrument", "entry_index", "row_index", "held_out", "label", "close", *rounded("p_close"))


def _with_hour(spark, sf_dir):
    return labelled(spark, sf_dir).withColumn("hour", F.hour("time").cast("double"))


NAMES = [*COLUMNS, "hour"]


@query("boosted_signals")
def boosted_signals(spark, sf_dir):
    """The latest fifth of the rows, scored by three-class boosting that learned from the rest and stopped on its latest fifth."""
    from tickloom.ml.boosting import Rules, score, train

    own = stored(_with_hour(spark, sf_dir), "labelled")
    early, late = (own.agg(F.percentile_approx(F.unix_micros(F.col("time").cast("timestamp")), share)).first()[0] or 0 for share in (0.64, 0.8))
    at = F.unix_micros(F.col("time").cast("timestamp"))
    model = train(own.where(at < late).withColumn("held_out", at >= early), NAMES, rules=Rules(rounds=8, depth=3, rate=0.3, patience=3))
    p = [F.get("p", F.lit(i)) for i in range(3)]
    signal = F.when((p[1] >= 0.4) & (p[1] > p[2]), 1).when((p[2] >= 0.4) & (p[2] > p[1]), -1).otherwise(0)
    return score(model, own.where(at >= late)).select("instrument", "idx", "target", signal.alias("signal"), F.round(p[1], 6).alias("p_buy"), F.round(p[2], 6).alias("p_sell"))


@query("walk_forward_fits")
def walk_forward_fits(spark, sf_dir):
    """A model for each window of ten days, tested on the three days that follow a gap as long as labels stay open."""
    from tickloom.ml import walk
    from tickloom.ml.boosting import Rules

    day = 24 * 3600
    out = walk.walk_forward_fits(_with_hour(spark, sf_dir), NAMES, "target", 10 * day, 4 * 3600, 3 * day, Rules(rounds=10, depth=2, rate=0.3, patience=3))
    return out.select("window", "instrument", "idx", "target", "n_learned", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p_none", "p_buy", "p_sell"))])


@query("nested_search")
def nested_search(spark, sf_dir):
    """Stops and targets outside; inside, over the labels that these give, how far from its mean a price must be, and at which hours."""
    from tickloom.ml.parzen import Range, nested_search as nested

    rows = stored(_rows(spark, sf_dir), "search-rows")
    features = scalping(bars(spark, sf_dir)).select("instrument", "time", *COLUMNS)
    seen = stored(asof_join(rows.select("instrument", "time", "idx"), features, ["instrument"], ["mean_rev_z", "roc_fast"], "1 hour"), "search-features")

    def prepare(params):
        labels = L.barrier_labels(rows, F.lit(params["stop"]), F.lit(params["target"]), TIMEOUT)
        decided = labels.where("buy_label >= 0 or sell_label >= 0").select("instrument", "idx", "buy_pnl", "sell_pnl")
        return stored(decided.join(seen, ["instrument", "idx"]).withColumn("hour", F.hour("time")), "search-labels")

    def profit(params):
        open_ = F.pmod(F.col("hour") - params["first_hour"], F.lit(24)) < params["hours"]
        buys, sells = F.col("mean_rev_z") <= -params["least_z"], F.col("mean_rev_z") >= params["least_z"]
        return F.when(open_ & buys, F.col("buy_pnl")).when(open_ & sells, F.col("sell_pnl"))

    outer = {"stop": Range(20.0, 80.0), "target": Range(20.0, 120.0)}
    inner = {"least_z": Range(0.0, 1.5), "first_hour": Range(0.0, 23.0, whole=True), "hours": Range(4.0, 24.0, whole=True)}
    out = []
    for number, trial in enumerate(nested(outer, inner, prepare, profit)):
        out += [(number, i, *(float(v) for v in (*trial.params.values(), *t.params.values())), float(t.score), bool(t.score == trial.score)) for i, t in enumerate(trial.inner)]
    names = ", ".join(f"{n} double" for n in (*outer, *inner))
    return spark.createDataFrame(out, f"outer_trial int, inner_trial int, {names}, score double, best boolean")
