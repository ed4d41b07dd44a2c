"""Models fitted inside walk-forward windows: each window has its own, learned from rows that ended before its test begins."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.ml.boosting import Rules, bin_edges, train_each, train_local
from tickloom.operators.series import with_index
from tickloom.sources.scratch import stored

MICROS = 1_000_000
#: A window that learns from more rows than that is fitted by histograms that Spark sums; one of fewer rows in one task.
LOCAL_ROWS = 200_000
#: So many of the larger windows are fitted side by side.
TOGETHER = 64
#: Blocks of time in which the rows of a larger window are numbered.
BLOCKS = 256
#: The last share of a window's rows, by time, tells when to stop.
LATER = 0.2
#: A window that tests more rows than that is dealt over several tasks, each with its model.
JUDGED_ROWS = 100_000


def windows_of(at: Column, first: int, train_s: int, gap_s: int, test_s: int) -> tuple[Column, Column]:
    """Numbers of the windows that learn from a row and of the one that it tests, by microseconds ``at``.

    Window w learns from ``train_s`` seconds from first + w * test_s on, leaves a gap in which labels are still open, and
    tests the ``test_s`` seconds behind it. Windows follow each other without end; a row lies in a bounded number of them.
    """
    second = F.floor((at - first) / MICROS)
    last = F.floor(second / test_s)
    begun = F.greatest(F.floor((second - train_s) / test_s) + 1, F.lit(0))
    learns = F.when(begun <= last, F.sequence(begun, last)).otherwise(F.array().cast("array<bigint>"))
    tests = F.floor((second - train_s - gap_s) / test_s)
    return learns, F.when(tests >= 0, tests)


def _ranked(learned: DataFrame, columns: Sequence[str], train_s: int) -> DataFrame:
    """key, y, late and the columns of the rows of windows with ``n`` rows each; late are the last of a window, by time."""
    named = learned.withColumnRenamed("idx", "own_idx").withColumn("time", F.timestamp_micros("at"))
    numbered = with_index(named, ("window",), ("time", "instrument", "own_idx"), f"{-(-train_s // BLOCKS)} seconds")
    late = F.col("idx") >= F.col("n") * (1 - LATER)
    ranked = numbered.select(F.col("window").alias("key"), F.col("target").alias("y"), late.alias("late"), *columns, "at")
    return stored(ranked.repartitionByRange("key", "at"), "ranked")


def walk_forward_fits(rows: DataFrame, columns: Sequence[str], label: str, train_s: int, gap_s: int, test_s: int, rules: Rules | None = None) -> DataFrame:
    """window, instrument, idx, target and ``p`` (array) of every row that some window tests.

    ``rows`` has instrument, idx, time, the label and the columns. Each window learns from all its rows that have a label, in
    a task of its own, or spread over many if they are more than ``LOCAL_ROWS``; models go to the rows they test by the
    number of their window. A window that has no rows to learn from tests none.
    """
    rules, columns = rules or Rules(), list(columns)
    at = F.unix_micros(F.col("time").cast("timestamp"))
    own = rows.select("instrument", "idx", at.alias("at"), F.col(label).cast("int").alias("target"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    own = stored(own, "walked")
    first = own.agg(F.min("at")).first()[0] or 0
    learns, tests = windows_of(F.col("at"), first, train_s, gap_s, test_s)
    learned = own.where(F.col("target").isNotNull()).withColumn("window", F.explode(learns))
    sizes = stored(learned.groupBy("window").agg(F.count("*").alias("n"), F.max("at").alias("learned_to")), "windows")
    large = sizes.where(F.col("n") > LOCAL_ROWS).orderBy("window").collect()
    small = learned.join(F.broadcast(sizes.where(F.col("n") <= LOCAL_ROWS).select("window")), "window")
    edges = bin_edges(own, columns, rules.bins)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "instrument", "idx"])
        later = np.arange(len(group)) >= len(group) * (1 - LATER)
        model = train_local(group[columns].to_numpy(), group["target"].to_numpy(), later, columns, edges, rules)
        return pd.DataFrame({"window": [key[0]], "model": [pickle.dumps(model)], "learned_to": [int(group["at"].max())], "n_learned": [len(group)]})

    schema = "window long, model binary, learned_to long, n_learned long"
    models = small.groupBy("window").applyInPandas(fit, schema)
    for start in range(0, len(large), TOGETHER):
        told = {r["window"]: r for r in large[start : start + TOGETHER]}
        ranked = _ranked(learned.join(F.broadcast(sizes.where(F.col("window").isin(list(told))).select("window", "n")), "window"), columns, train_s)
        fitted = train_each(ranked, list(told), columns, edges, rules)
        models = models.unionByName(own.sparkSession.createDataFrame([(w, pickle.dumps(m), told[w]["learned_to"], told[w]["n"]) for w, m in fitted.items()], schema))
    models = stored(models, "models")
    tested = own.withColumn("window", tests).where(F.col("window").isNotNull())
    dealt = tested.groupBy("window").agg(F.ceil(F.count("*") / JUDGED_ROWS).cast("int").alias("salts"))
    heads = models.join(dealt, "window").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    body = tested.join(dealt, "window").withColumn("salt", F.pmod(F.xxhash64("instrument", "idx"), F.col("salts")).cast("int")).drop("salts")
    both = heads.unionByName(body, allowMissingColumns=True).repartition("window", "salt").sortWithinPartitions("window", "salt", F.col("model").isNull())
    kept = ["window", "instrument", "idx", "at", "target", "learned_to", "n_learned"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The model of a window comes before its rows and is held until the next one."""
        known, model, told = None, None, (0, 0)
        for batch in batches:
            for window, part in batch.groupby("window", sort=False):
                head = part[part["model"].notna()]
                if len(head):
                    known, model, told = window, pickle.loads(head["model"].iloc[0]), (head["learned_to"].iloc[0], head["n_learned"].iloc[0])
                rows = part[part["model"].isna()]
                if known == window and len(rows):
                    scored = rows.assign(learned_to=told[0], n_learned=told[1], p=list(model.probabilities(rows[columns].to_numpy())))
                    yield scored[[*kept, "p"]]

    return both.select(*kept, "model", *columns).mapInPandas(judge, "window long, instrument string, idx long, at long, target int, learned_to long, n_learned long, p array<double>")
