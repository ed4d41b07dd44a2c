"""The first touch of an interval against a plain scan, for trees of several levels."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import touch
from tickloom.operators.touch import first_touch


@pytest.mark.parametrize("width", [5, 64])
def test_first_touch(spark, width):
    rng = random.Random(width)
    rows, queries = [], []
    for name, n in (("a", 90), ("b", 17), ("c", 1)):
        for i in range(n):
            mid = rng.uniform(0, 100)
            rows.append((name, i, mid, mid + rng.uniform(0, 4)))
        for _ in range(40):
            low = rng.uniform(-10, 110)
            a, b = rng.choice([(float("-inf"), low), (low, float("inf")), (low, low), (low, low + 1)])
            queries.append((name, rng.randint(-1, n), a, b))
    own = spark.createDataFrame(rows, "instrument string, idx long, lo double, hi double")
    asked = spark.createDataFrame([(*q, k) for k, q in enumerate(queries)], "instrument string, after long, `from` double, to double, number int")
    got = {r.number: r.hit_idx for r in first_touch(asked, own, width=width).collect()}
    want = {k: min((i for n, i, lo, hi in rows if n == name and i > after and lo <= b and hi >= a), default=None) for k, (name, after, a, b) in enumerate(queries)}
    assert got == want


def test_broken_promises_cost_a_round_a_level(spark, monkeypatch):
    """Rows alternate around the price that is asked for, so that every block promises it; the last row has it."""
    rounds = []
    real = touch._round
    monkeypatch.setattr(touch, "_round", lambda *a: rounds.append(a[-1]) or real(*a))
    rows = spark.range(6000).select(F.lit("a").alias("instrument"), F.col("id").alias("idx"), F.when(F.col("id") == 5990, 5.0).when(F.col("id") % 2 == 0, 0.0).otherwise(10.0).alias("lo")).withColumn("hi", F.col("lo"))
    asked = spark.createDataFrame([("a", 3, 5.0, 5.0), ("a", 5990, 5.0, 5.0), ("a", 0, 4.0, 11.0)], "instrument string, after long, `from` double, to double")
    got = {(r.after, r["from"]): r.hit_idx for r in touch.first_touch(asked, rows).collect()}
    assert got == {(3, 5.0): 5990, (5990, 5.0): None, (0, 4.0): 1}
    assert len(rounds) <= 4


def test_no_rows(spark):
    own = spark.createDataFrame([], "instrument string, idx long, lo double, hi double")
    asked = spark.createDataFrame([("a", 0, 1.0, 2.0)], "instrument string, after long, `from` double, to double")
    assert [r.hit_idx for r in first_touch(asked, own).collect()] == [None]
    assert first_touch(asked.where(F.lit(False)), own).count() == 0
