"""Draws by densities against plain loops; a search is repeated by its seed and better than chance."""

import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from tickloom.ml import parzen as P

SPACE = {"x": P.Range(-5.0, 5.0), "k": P.Range(1.0, 20.0, whole=True)}


def worth(params):
    return -((params["x"] - 2) ** 2) - abs(params["k"] - 13) / 4


def evaluate(drawn):
    return [P.Trial(p, worth(p)) for p in drawn]


def plain_density(at, values, low, high):
    values, total = sorted(values), 1 / (high - low)
    for i, v in enumerate(values):
        gap = max(v - (values[i - 1] if i else low), (values[i + 1] if i + 1 < len(values) else high) - v)
        width = min(max(gap, (high - low) / min(50, len(values) + 1)), high - low)
        total += math.exp(-0.5 * ((at - v) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return total / (len(values) + 1)


def test_densities():
    rng = random.Random(2)
    values = [rng.uniform(-5, 5) for _ in range(9)] + [1.0, 1.0]
    at = np.linspace(-5, 5, 41)
    got = P.density(at, *P.kernels(values, SPACE["x"]), SPACE["x"])
    assert np.allclose(got, [plain_density(a, values, -5, 5) for a in at])
    assert np.allclose(P.density(at, *P.kernels([], SPACE["x"]), SPACE["x"]), 0.1)


def test_the_candidate_with_the_best_ratio_is_taken(monkeypatch):
    trials = evaluate(P.Parzen(SPACE, 1).draw([], 12))
    seen, real = [], P.density
    monkeypatch.setattr(P, "density", lambda at, *rest: seen.append(at.copy()) or real(at, *rest))
    drawn = P.Parzen({"x": SPACE["x"]}, 5).draw(trials, 1)[0]["x"]
    ranked = [t.params["x"] for t in sorted(trials, key=lambda t: -t.score)]
    assert drawn == max(seen[0], key=lambda a: plain_density(a, ranked[:3], -5, 5) / plain_density(a, ranked[3:], -5, 5))


def test_repeats_and_beats_chance():
    runs = [[P.search(SPACE, evaluate, 8, 6, seed) for seed in range(15)] for _ in range(2)]
    assert [[t.params for t in r] for r in runs[0]] == [[t.params for t in r] for r in runs[1]]
    chance = [max(worth(p) for p in P.Parzen(SPACE, 100 + seed).draw([], 48)) for seed in range(15)]
    assert statistics.mean(P.best(r).score for r in runs[0]) > statistics.mean(chance)
    assert all(t.params["k"] == int(t.params["k"]) and -5 <= t.params["x"] <= 5 for r in runs[0] for t in r)


def test_nested_search_over_rows(spark):
    """The rows of an outer trial pay by how near its shift is to 3, the inner ones by a threshold."""
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)], "z double, noise double").cache()
    outer, inner = {"shift": P.Range(0.0, 6.0)}, {"least": P.Range(-2.0, 2.0)}
    tables = []

    def prepare(params):
        tables.append(params["shift"])
        return rows.withColumn("pnl", F.col("z") + F.col("noise") - (params["shift"] - 3.0) ** 2)

    def profit(params):
        return F.when(F.col("z") >= params["least"], F.col("pnl"))

    found = P.nested_search(outer, inner, prepare, profit, rounds=(2, 2), batch=(2, 4))
    assert [t.params["shift"] for t in found] == tables and all(len(t.inner) == 8 for t in found)
    own = [(r.z, r.noise) for r in rows.collect()]
    for t in found:
        assert t.score == max(i.score for i in t.inner)
        for i in t.inner:
            pnl = [z + e - (t.params["shift"] - 3) ** 2 for z, e in own if z >= i.params["least"]]
            want = statistics.mean(pnl) / statistics.stdev(pnl) * math.sqrt(len(pnl)) if len(pnl) >= 20 else P.REJECTED
            assert math.isclose(i.score, want, rel_tol=1e-6)
    assert abs(P.best(found).params["shift"] - 3) == min(abs(s - 3) for s in tables)
