"""Operators against direct folds over small series, and plans against what they must not contain."""

import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import labels, patterns, sim
from tickloom.operators.asof import asof_join
from tickloom.operators.series import bounded, running, with_index
from tickloom.sources import readers

START = datetime(2024, 1, 1)
BAR = "instrument string, time timestamp_ntz, idx long, open double, high double, low double, close double, spread double, tick_count long"


def bars_of(spark, highs, lows, name="a"):
    rows = [(name, START + timedelta(hours=i), i, float(lo), float(h), float(lo), float(h), 0.5, 1) for i, (h, lo) in enumerate(zip(highs, lows))]
    return spark.createDataFrame(rows, BAR)


def swings_by_hand(values, left, right, better):
    n = len(values)
    return [i for i in range(left, n - right) if all(better(values[i], values[j]) for j in range(i - left, i + right + 1) if j != i)]


def breaks_by_hand(highs, lows, left, right):
    sh = set(swings_by_hand(highs, left, right, lambda a, b: a >= b))
    sl = set(swings_by_hand(lows, left, right, lambda a, b: a <= b))
    out, top, bottom, last = [], None, None, None
    for i in range(len(highs)):
        if i - right in sh:
            top = highs[i - right]
        if i - right in sl:
            bottom = lows[i - right]
        if top is not None and highs[i] > top:
            out.append((i, "bullish", "BOS" if last in (None, "bullish") else "CHOCH"))
            last, top = "bullish", None
        if bottom is not None and lows[i] < bottom:
            out.append((i, "bearish", "BOS" if last in (None, "bearish") else "CHOCH"))
            last, bottom = "bearish", None
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 3)), min_size=12, max_size=60), st.integers(1, 3), st.integers(1, 3))
def test_structure_breaks(spark, pairs, left, right):
    highs, lows = [float(h) for h, _ in pairs], [float(h - w) for h, w in pairs]
    got = patterns.structure_breaks(bars_of(spark, highs, lows), left, right).orderBy("idx", "rank").collect()
    assert [(r.idx, r.direction, r.kind) for r in got] == breaks_by_hand(highs, lows, left, right)


def test_swings_keep_plateaus(spark):
    got = patterns.swings(bars_of(spark, [1, 2, 5, 5, 2, 1, 1], [0] * 7), 1, 1).where("kind = 'high'")
    assert sorted(r.idx for r in got.collect()) == [2, 3]


def test_gaps(spark):
    got = patterns.gaps(bars_of(spark, [10, 12, 20, 21, 14, 9], [9, 11, 15, 16, 13, 7])).orderBy("idx").collect()
    assert [(r.idx, r.kind, r.top, r.bottom) for r in got] == [(1, "bullish", 15.0, 10.0), (2, "bullish", 16.0, 12.0), (3, "bearish", 15.0, 14.0), (4, "bearish", 16.0, 9.0)]


def test_flags_do_not_depend_on_chunks(spark, monkeypatch):
    """Steps that build on one another over copied edge rows: as many as 16 rows back and 2 ahead."""
    values = [50 + float((i * 7919) % 23) for i in range(120)]
    own = bars_of(spark, values, [v - (i * 31) % 7 for i, v in enumerate(values)])
    whole = patterns.armed(patterns.flagged(own)).orderBy("idx").collect()
    atr = patterns.with_atr(own, 14, 1).orderBy("idx").collect()
    assert [r.atr_known for r in whole] == [r.atr for r in atr]
    for name in ("bounded", "running"):
        plain = getattr(patterns, name)
        monkeypatch.setattr(patterns, name, lambda *a, _plain=plain, **k: _plain(*a, **k, rows=17))
    assert patterns.armed(patterns.flagged(own)).orderBy("idx").collect() == whole


@pytest.mark.parametrize("rows", [4, 7, 100])
def test_bounded_and_running_do_not_depend_on_chunks(spark, rows):
    values = [float((i * 7919) % 101) for i in range(60)]
    df = bars_of(spark, values, values).withColumn("x", F.when(F.col("idx") % 3 != 0, F.col("close")))
    ranged = bounded(df, lambda w: {"m": F.max("close").over(w.rowsBetween(-3, 2))}, back=3, ahead=2, rows=rows)
    got = {r.idx: r.m for r in ranged.collect()}
    assert got == {i: max(values[max(0, i - 3) : i + 3]) for i in range(60)}
    run = running(df, {"s": ("sum", F.col("x")), "t": ("max", F.col("x")), "last_x": ("last", F.col("x"))}, rows=rows)
    held = {r.idx: (r.s, r.t, r.last_x) for r in run.collect()}
    seen = []
    for i, v in enumerate(values):
        seen += [v] if i % 3 else []
        assert held[i] == ((sum(seen), max(seen), seen[-1]) if seen else (None, None, None))


def test_index_over_blocks(spark):
    rows = [("a", START + timedelta(days=(i * 37) % 400)) for i in range(100)]
    df = spark.createDataFrame(rows, "instrument string, time timestamp_ntz")
    assert [r.idx for r in with_index(df).orderBy("time").collect()] == list(range(100))


@pytest.mark.parametrize("block", ["1 day", "30 days"])
def test_asof_includes_equal_times_and_carries_over_blocks(spark, block):
    left = spark.createDataFrame([("a", START + timedelta(days=d), d) for d in (0, 1, 2, 9, 40)], "instrument string, time timestamp_ntz, n int")
    right = spark.createDataFrame([("a", START + timedelta(days=d), d * 10) for d in (1, 3)], "instrument string, time timestamp_ntz, v int")
    got = {r.n: r.v for r in asof_join(left, right, ["instrument"], ["v"], block=block).collect()}
    assert got == {0: None, 1: 10, 2: 10, 9: 30, 40: 30}


def labels_by_hand(rows, stop, target, span):
    out = []
    for i, (t, bid, ask) in enumerate(rows):
        label = {}
        for side in ("buy", "sell"):
            label[side] = -1
            for u, b, a in rows[i + 1 :]:
                gain = b - ask if side == "buy" else bid - a
                if u - t > span:
                    label[side] = 1 if round(gain, 9) > 0 else 0 if round(gain, 9) < 0 else -1
                    break
                if gain <= -stop:
                    label[side] = 0
                    break
                if gain >= target:
                    label[side] = 1
                    break
        out.append((label["buy"], label["sell"]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_barrier_labels(spark, seed):
    rng = random.Random(seed)
    rows, t, price = [], 0, 100.0
    for _ in range(120):
        t += rng.choice([1, 1, 2, 30])
        price += rng.choice([-1, -0.5, 0, 0.5, 1])
        rows.append((t, price, price + 0.5))
    df = spark.createDataFrame([("a", i, START + timedelta(seconds=t), b, a) for i, (t, b, a) in enumerate(rows)], "instrument string, idx long, time timestamp_ntz, bid double, ask double")
    got = labels.barrier_labels(df, F.lit(2.0), F.lit(1.5), 20).orderBy("idx").collect()
    assert [(r.buy_label, r.sell_label) for r in got] == labels_by_hand(rows, 2.0, 1.5, 20)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_barrier_labels_over_many_blocks_and_gaps(spark, seed, monkeypatch):
    monkeypatch.setattr(labels, "LEAST_BLOCK", 1)
    rng = random.Random(seed)
    rows, t, price = [], 0, 100.0
    for _ in range(400):
        t += rng.choice([0, 1, 1, 2, 7, 30, rng.choice([1, 20, 21, 100, 500])])
        price += rng.choice([-1, -0.5, 0, 0.5, 1])
        rows.append((t, price, price + 0.5))
    df = spark.createDataFrame([("a", i, START + timedelta(seconds=t), b, a) for i, (t, b, a) in enumerate(rows)], "instrument string, idx long, time timestamp_ntz, bid double, ask double")
    got = labels.barrier_labels(df, F.lit(2.0), F.lit(1.5), 20).orderBy("idx").collect()
    assert [(r.buy_label, r.sell_label) for r in got] == labels_by_hand(rows, 2.0, 1.5, 20)
    beyond = [next((j for j in range(len(rows)) if rows[j][0] > at + 20), None) for at, _, _ in rows]
    timed_out = [i for i, r in enumerate(got) if r.buy_exit is not None and r.buy_pnl not in (-2.0, 1.5)]
    assert timed_out and [got[i].buy_exit for i in timed_out] == [beyond[i] for i in timed_out]


def test_barrier_labels_write_their_rows_once_and_pass_over_nulls(spark):
    rows = [("a", 0, 100.0, 100.5), ("a", 1, None, None), ("a", 2, 97.0, 97.5), ("a", 3, 99.0, 99.5), (None, 0, 100.0, 100.5), (None, 1, 103.0, 103.5)]
    df = spark.createDataFrame([(k, i, START + timedelta(seconds=i), b, a) for k, i, b, a in rows], "instrument string, idx long, time timestamp_ntz, bid double, ask double")
    spark.sparkContext.setJobGroup("labels", "labels")
    try:
        found = labels.barrier_labels(df, F.lit(2.0), F.lit(2.0), 20)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("labels")) <= 2  # no table for each level of a tree
    got = {(r.instrument, r.idx): (r.buy_label, r.buy_exit, r.sell_label, r.sell_exit) for r in found.collect()}
    assert got == {("a", 0): (0, 2, 1, 2), ("a", 1): (-1, None, -1, None), ("a", 2): (-1, None, 0, 3), ("a", 3): (-1, None, -1, None), (None, 0): (1, 1, 0, 1), (None, 1): (-1, None, -1, None)}


def test_tick_run_stops_before_targets_and_closes_the_rest(spark):
    quotes = [(100.0, 100.5, 1), (97.0, 97.5, 0), (97.0, 97.5, -1), (96.0, 96.5, 0)]
    rows = [("a", i, b, k, 0.0, s, 0.5) for i, (b, k, s) in enumerate(quotes)]
    df = spark.createDataFrame(rows, "instrument string, idx long, bid double, ask double, atr double, signal int, confidence double")
    got = sim.simulate(df, sim.TickRun, {"r": sim.TickRules(stop=3.0, target=3.0, size=1.0)}).orderBy("exit_idx").collect()
    assert [(r.direction, r.reason, r.pnl) for r in got] == [("BUY", "stop", -3.0), ("SELL", "end", 0.5)]
    assert math.isclose(got[0].r_multiple, -1.0)


def test_candle_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,O,H,L,C\n2024-01-02 00:00:00,1,2,0.5,1.5\n2024-01-01 00:00:00,1,2,0.5,1.5\n")
    got = readers.candles_csv(spark, str(tmp_path / "x.csv")).collect()
    assert {r.time.day for r in got} == {1, 2} and all(r.volume == 0.0 for r in got)
    (tmp_path / "y.csv").write_text("Date,O,H,L\n2024-01-02,1,2,0.5\n")
    with pytest.raises(ValueError, match="close"):
        readers.candles_csv(spark, str(tmp_path / "y.csv"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "eur.csv").write_text("time,open,high,low,close\n2024-01-02 00:00:00,1,2,0.5,1.5\n")
    assert readers.directory_csv(spark, str(tmp_path / "d"), {"EUR": "EUR/USD"}).first().instrument == "EUR/USD"


def test_plans_have_no_cartesian_product_and_push_filters(spark):
    from __spark_entry__ import queries

    QUERIES = queries()
    small = "/root/testdata/sf0.001"
    for name in ("labels_fixed", "fvg_mitigation", "exit_dataset", "news_near", "asof_h1"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    plan = QUERIES["tick_range_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan
