"""Walk-forward windows, recursive means and sizes against plain Python."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.functions import market as M
from tickloom.operators import stats as S
from tickloom.operators.rolling import recursive_mean


def test_each_trade_is_in_all_its_windows(spark):
    rows = [(i, datetime(2020, 1, 1) + timedelta(days=7 * i), 1.0, i % 3) for i in range(60)]
    trades = spark.createDataFrame(rows, "trade_id int, opened_at timestamp_ntz, pnl double, trial int")
    got = {(r.trade_id, r.window, r.phase) for r in S.in_windows(trades, "2020-01-10", 60, 20, 15).collect()}
    want = set()
    for i, at, *_ in rows:
        day = (at - datetime(2020, 1, 10)).days
        want |= {(i, k, "train" if day - 15 * k < 60 else "test") for k in range(60) if 0 <= day - 15 * k < 80}
    assert got == want


def test_the_best_trial_of_the_training_part_is_tested(spark):
    rng = random.Random(2)
    rows = [(i, datetime(2020, 1, 1) + timedelta(days=i // 4), rng.gauss(5.0 if i % 4 == 2 else -5.0, 1.0), i % 4) for i in range(800)]
    trades = spark.createDataFrame(rows, "trade_id int, opened_at timestamp_ntz, pnl double, trial int")
    found = S.walk_forward(trades, "2020-01-01", 60, 20, 20).collect()
    assert len(found) >= 7 and all(r.trial == 2 for r in found)
    assert all(r.n_trades == 20 and r.total_pnl > 0 for r in found if r.window < 6)


@pytest.mark.parametrize("first", [0, 1])
def test_recursive_mean_over_many_chunks(spark, first):
    rng = random.Random(first)
    values = [rng.uniform(-3, 9) for _ in range(700)]
    df = spark.createDataFrame([("a", i, v if i >= first else None) for i, v in enumerate(values)], "instrument string, idx long, v double")
    got = {r.idx: r.m for r in recursive_mean(df, {"m": F.col("v")}, 6, first).collect()}
    mean = None
    for i, v in enumerate(values):
        if i >= first:
            mean = v if mean is None else v / 6 + mean * 5 / 6
            assert math.isclose(got[i], mean, rel_tol=1e-7, abs_tol=1e-7)
        else:
            assert got[i] is None


def test_sizes_on_the_ramp(spark):
    def size(proba, money):
        return spark.range(1).select(M.gamma_size(F.lit(proba), 0.5, 2.0, 0.9, F.lit(money), F.lit(100.0), 0.1)).first()[0]

    assert size(0.95, 1000.0) == pytest.approx(10.0) and size(0.9, 1000.0) == pytest.approx(10.0)
    assert size(0.7, 1000.0) == pytest.approx(2.5) and size(0.5, 1000.0) is None and size(0.3, 1000.0) is None
    assert size(0.95, 9.0) is None and size(0.95, -1.0) is None


def test_walk_forward_takes_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    rows = [(i % 3, i, datetime(2020, 1, 1) + timedelta(days=i % 150), float(i % 7 - 2), "x" * 100) for i in range(900)]
    trades = spark.createDataFrame(rows, "trial long, trade_id long, opened_at timestamp_ntz, pnl double, note string")
    whole = sorted(map(repr, S.walk_forward(trades, "2020-01-01", 60, 20, 20).collect()))
    seen = []
    plain = S.trade_metrics
    monkeypatch.setattr(S, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(S, "trade_metrics", lambda df, *a, **k: seen.append((df.columns, df.rdd.getNumPartitions())) or plain(df, *a, **k))
    assert sorted(map(repr, S.walk_forward(trades, "2020-01-01", 60, 20, 20).collect())) == whole
    assert set(seen[0][0]) == {"trial", "trade_id", "opened_at", "pnl", "window", "phase"} and seen[0][1] == 37
