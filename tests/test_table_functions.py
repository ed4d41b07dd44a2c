"""The table function of sequences against slices of arrays, in batches of several sizes."""

import numpy as np
import pytest

from tickloom.operators import table_functions

SIZES = {("a", 0): 23, ("a", 1): 4, ("b", 0): 3, ("c", 2): 10}


@pytest.mark.parametrize("batch, length, stride", [(10_000, 4, 2), (3, 4, 2), (1, 4, 3), (5, 7, 1), (2, 3, 9)])
def test_windows(spark, batch, length, stride):
    table_functions.register(spark)
    data = {k: np.random.default_rng(n).normal(size=(n, 2)) for k, n in SIZES.items()}
    rows = [(name, segment, 100 * segment + i, float(x), float(y)) for (name, segment), own in data.items() for i, (x, y) in enumerate(own)]
    spark.createDataFrame(rows[::-1], "instrument string, segment long, idx long, x double, y double").createOrReplaceTempView("sequence_rows")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = spark.sql(f"SELECT * FROM sequences(rows => TABLE(sequence_rows) PARTITION BY (instrument, segment) ORDER BY (idx), length => {length}, stride => {stride})").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(n, s, 100 * s + i): own[i : i + length].ravel().tolist() for (n, s), own in data.items() for i in range(0, len(own) - length + 1, stride)}
    assert {(r.instrument, r.segment, r.start_idx): r.features for r in got} == want and len(got) == len(want)
