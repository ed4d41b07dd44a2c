"""Taken trades against a walk along each series."""

import random

from tickloom.operators import series
from tickloom.operators.selection import one_at_a_time


def test_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(series.running, "__defaults__", (series.KEYS, 16))  # chunks of 16 rows
    rng, rows, want = random.Random(3), [], []
    for name, n, longest in (("a", 300, 3), ("b", 200, 60), ("c", 1, 1), ("d", 40, 0)):
        own = [(name, i, None if rng.random() < 0.01 else i + rng.randint(0 if longest else 1, longest or 500)) for i in range(n) if rng.random() < 0.8 or n == 1]
        own = [(k, i, e if e is None or e > i else i + 1) for k, i, e in own]
        rows += own
        free = -1
        for k, i, e in own:
            if free is not None and i >= free:
                want.append((k, i, e))
                free = e
    frame = spark.createDataFrame([*rows, ("a", None, 3)], "instrument string, idx long, exit_idx long")
    assert sorted(map(repr, map(tuple, one_at_a_time(frame).collect()))) == sorted(map(repr, want))


def test_many_entries_with_one_exit_and_none_at_all(spark):
    frame = spark.createDataFrame([("a", i, 500) for i in range(500)] + [("a", 500, 501), ("a", 600, None), ("a", 700, 701)] + [("b", 4, 4), ("b", 5, 2), ("b", 7, 9)], "instrument string, idx long, exit_idx long")
    assert sorted((r.instrument, r.idx) for r in one_at_a_time(frame).collect()) == [("a", 0), ("a", 500), ("a", 600), ("b", 4), ("b", 5), ("b", 7)]
    assert one_at_a_time(frame.limit(0)).count() == 0
