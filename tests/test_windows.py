"""Walk-forward ranges of many series against a loop, sinks, and orders that slip."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.functions import market as M
from tickloom.operators import windows as V
from tickloom.operators.registry import standard
from tickloom.sources import readers as R

SPANS = [("a", date(2023, 1, 31), date(2024, 12, 31)), ("b", date(2024, 2, 29), date(2024, 3, 1)), ("c", date(2024, 1, 1), date(2024, 1, 29)), ("d", date(2024, 1, 3), date(2024, 2, 20))]


@pytest.fixture()
def spans(spark):
    return spark.createDataFrame(SPANS, "series string, first date, last date")


@pytest.mark.parametrize("monday", [False, True])
@pytest.mark.parametrize("validation", [0, 3])
def test_day_windows(spans, monday, validation):
    want = set()
    for name, first, last in SPANS:
        at, n = first + timedelta(days=-first.weekday() % 7 if monday else 0), 0
        while at + timedelta(days=14 + 7 + validation) <= last:
            want.add((name, n, at, at + timedelta(days=14), at + timedelta(days=21), at + timedelta(days=24) if validation else None))
            at, n = at + timedelta(days=5), n + 1
    got = V.day_windows(spans, 14, 7, 5, monday, validation).collect()
    assert {(r.series, r.window, r.train_start, r.test_start, r.test_end, r.validation_end if validation else None) for r in got} == want
    assert len(got) == len(want) and {"a", "d"} <= {w[0] for w in want}


def test_month_windows(spans):
    got = V.month_windows(spans, 12, 3).orderBy("window").collect()
    assert [(r.series, r.window, str(r.train_start), str(r.test_start), str(r.test_end)) for r in got] == [
        ("a", k, *days) for k, days in enumerate([("2023-01-28", "2024-01-28", "2024-04-28"), ("2023-04-28", "2024-04-28", "2024-07-28"), ("2023-07-28", "2024-07-28", "2024-10-28")])
    ]


def test_month_ranges(spans):
    got = [(str(r.range_start), str(r.range_end)) for r in V.month_ranges(spans).where("series = 'd'").orderBy("range_start").collect()]
    assert got == [("2024-01-03", "2024-02-01"), ("2024-02-01", "2024-02-20")]
    assert [str(r.range_end) for r in V.month_ranges(spans).where("series = 'b'").collect()] == ["2024-03-01"]


def test_spans_of_no_rows(spark):
    empty = spark.createDataFrame([("a", None)], "series string, ts timestamp")
    assert V.day_windows(V.spans(empty, ["series"], "ts"), 1, 1, 1).count() == 0


def test_trial_log(spark, tmp_path):
    trials = spark.createDataFrame([(0, 1, 2.5), (0, 2, -1.0), (1, 1, 0.0)], "window long, trial long, score double")
    params = spark.createDataFrame([(0, 1, "outer", "n", 3.0), (0, 1, "inner", "n", 4.0), (1, 1, "outer", "k", 5.0)], "window long, trial long, part string, name string, value double")
    R.write_trial_log(trials, params, ["window", "trial"], str(tmp_path / "log"))
    got = R.read_trial_log(spark, str(tmp_path / "log"), "window long, trial long, score double").orderBy("window", "trial").collect()
    assert got[0].asDict() == {"window": 0, "trial": 1, "score": 2.5, "inner__n": 4.0, "outer__k": None, "outer__n": 3.0}
    assert [r.outer__k for r in got] == [None, None, 5.0]


def test_slipped_fill(spark):
    own = spark.range(4000).withColumn("buy", F.col("id") % 2 == 0)
    fill = M.slipped_fill(F.lit(10.0), F.lit(0.5), F.col("buy"), F.col("id"), 0.2, 0.1, 1)
    rows = own.select("buy", fill.alias("f")).select("buy", "f.*").collect()
    refused = [r for r in rows if not r.filled]
    assert 300 < len(refused) < 500 and all((r.price, r.spread_cost, r.slippage) == (10.0, 0.0, 0.0) for r in refused)
    bought, sold = [r.price for r in rows if r.filled and r.buy], [r.price for r in rows if r.filled and not r.buy]
    assert 10.5 <= min(bought) < max(bought) <= 10.7 and 9.8 <= min(sold) < max(sold) <= 10.0
    assert 0.08 < sum(r.slippage for r in rows if r.filled) / (len(rows) - len(refused)) < 0.12
    assert own.repartition(7).select("buy", fill.alias("f")).select("buy", "f.*").orderBy("price", "buy").collect() == own.select("buy", fill.alias("f")).select("buy", "f.*").orderBy("price", "buy").collect()


def test_never_refused(spark):
    assert spark.range(100).where(~M.slipped_fill(F.lit(1.0), F.lit(0.0), F.lit(True), F.col("id"), 0.0, 0.0, 1)["filled"]).count() == 0


def test_tunables_column(spark):
    names = [r.n for r in spark.range(1).select(F.explode(standard().tunables_column()["name"]).alias("n")).collect()]
    assert names == [t.name for t in standard().tunables()] and len(names) == 7
