"""The path of a trade runs to its exit row, however many rows that takes."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators import labels

START = datetime(2024, 1, 1)
TICK = "instrument string, idx long, time timestamp_ntz, bid double, ask double"


def paths(spark, prices, seconds):
    rows = [("a", i, START + timedelta(seconds=s), p, p + 0.5) for i, (p, s) in enumerate(zip(prices, seconds))]
    df = spark.createDataFrame(rows, TICK)
    target = F.when(F.col("idx") == 0, 1).otherwise(0)
    found = labels.exit_paths(labels.barrier_labels(df, F.lit(5.0), F.lit(5.0), 4 * 3600), df, target)
    return sorted((r.entry_index, r.row_index, r.unrealized) for r in found.collect())


def test_path_of_many_rows(spark):
    prices = [100.0] * 1500 + [110.0] * 3
    assert paths(spark, prices, range(1503)) == [(0, j, prices[j] - 100.5) for j in range(1, 1501)]


def test_path_to_an_exit_long_past_the_timeout(spark):
    prices, seconds = [100.0] * 700 + [101.0] * 2, [*range(700), 90_000, 90_001]
    assert paths(spark, prices, seconds) == [(0, j, prices[j] - 100.5) for j in range(1, 701)]
