"""Boosting on summed histograms against the same in memory, a search of the first split, and what it learns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.ml import boosting as B
from tickloom.ml import walk
from tickloom.ml.walk import walk_forward_fits

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3)).round(2)
    y = np.where(x[:, 0] + rng.normal(size=1500) * 0.3 > 0.7, 1, np.where(x[:, 1] * x[:, 0] < -0.4, 2, 0))
    return spark.createDataFrame([(int(i), *map(float, v), int(t), bool(i >= 1200)) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, target int, held_out boolean").repartition(5).cache()


def arrays(rows):
    own = rows.orderBy("id").toPandas()
    return own[COLUMNS].to_numpy(), own["target"].to_numpy(), own["held_out"].to_numpy()


def test_equals_the_model_in_memory(spark, rows):
    rules = B.Rules(rounds=7, depth=2, keep_every=3, bins=16)
    model, (x, y, later) = B.train(rows, COLUMNS, rules=rules), arrays(rows)
    local = B.train_local(x, y, later, COLUMNS, model.edges, rules)
    assert np.allclose(model.losses, local.losses) and len(model.rounds) == len(local.rounds)
    assert np.allclose(model.probabilities(x), local.probabilities(x))
    assert np.allclose(model.gains, local.gains) and model.importance()[-1][0] == "c"
    got = np.array([r.p for r in B.score(model, rows).orderBy("id").collect()])
    assert np.allclose(got, model.probabilities(x))


def test_first_split_is_the_best_of_all(rows):
    rules = B.Rules(rounds=1, depth=1, bins=8, patience=9)
    x, y, later = arrays(rows)
    edges = B.bin_edges(rows, COLUMNS, rules.bins)
    later = np.zeros_like(later)
    model = B.train_local(x, y, later, COLUMNS, edges, rules)
    start = np.exp(model.start)
    for c, tree in enumerate(model.rounds[0]):
        g, h = start[c] - (y == c), np.full(len(y), start[c] * (1 - start[c]))

        def worth(part):
            return g[part].sum() ** 2 / (h[part].sum() + rules.ridge)

        gains = {(f, k): worth(x[:, f] <= e) + worth(x[:, f] > e) for f in range(3) for k, e in enumerate(edges[f]) if min((x[:, f] <= e).sum(), (x[:, f] > e).sum()) * h[0] >= rules.least_hessian}
        assert (tree.feature[0], tree.cut[0]) == max(gains, key=lambda s: (round(gains[s], 7), -s[0], -s[1]))
        left = x[:, tree.feature[0]] <= edges[tree.feature[0]][tree.cut[0]]
        assert tree.value[1] == pytest.approx(-rules.rate * g[left].sum() / (h[left].sum() + rules.ridge))


def test_stops_on_later_rows_and_beats_a_forest(spark, rows):
    from pyspark.ml.functions import vector_to_array

    from tickloom.ml.search import train_entry

    model = B.train(rows, COLUMNS, rules=B.Rules(rounds=30, rate=0.3, patience=3))
    assert len(model.rounds) == int(np.argmin(model.losses)) and min(model.losses) < 0.7 * model.losses[0]
    x, y, later = arrays(rows)
    loss = -np.log(model.probabilities(x)[later, y[later]]).mean()
    forest = train_entry(rows.where("not held_out"), COLUMNS).transform(rows.where("held_out")).withColumn("p", vector_to_array("_probability"))
    assert loss < forest.agg(F.avg(-F.log(F.greatest(F.get("p", F.col("target")), F.lit(1e-15))))).first()[0]


@pytest.mark.parametrize("judged", [100_000, 17])
def test_windows_never_learn_from_what_they_test(spark, rows, monkeypatch, judged):
    monkeypatch.setattr(walk, "JUDGED_ROWS", judged)
    timed = rows.withColumns({"instrument": F.lit("x"), "idx": F.col("id").cast("long"), "time": F.timestamp_seconds(F.col("id") * 60)})
    rules = B.Rules(rounds=4, depth=2)
    out = walk_forward_fits(timed, COLUMNS, "target", 400 * 60, 20 * 60, 100 * 60, rules).orderBy("idx").collect()
    assert [r.idx for r in out] == list(range(420, 1500))
    assert all(r.at - r.learned_to > 20 * 60 * 10**6 and r.window == (r.idx - 420) // 100 for r in out)
    x, y, _ = arrays(rows)
    edges = B.bin_edges(timed, COLUMNS, rules.bins)
    for w in (0, 5, 10):
        part = slice(100 * w, 100 * w + 400)
        local = B.train_local(x[part], y[part], np.arange(400) >= 320, COLUMNS, edges, rules)
        got = {r.idx: r.p for r in out if r.window == w}
        assert np.allclose([got[i] for i in sorted(got)], local.probabilities(x[sorted(got)]))


@pytest.mark.parametrize("local_rows, least", [(200_000, 0), (20_000, 0), (100, 22_000)])
def test_windows_learn_from_all_their_rows(spark, monkeypatch, local_rows, least):
    """In one task or over many; labels of a later time than a window knows would change its model."""
    monkeypatch.setattr(walk, "LOCAL_ROWS", local_rows, raising=False)
    monkeypatch.setattr(walk, "TOGETHER", 2, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(31_000 - least, 3)).round(2)
    y = np.where(x[:, 0] + rng.normal(size=len(x)) * 0.3 > 0.7, 1, np.where(x[:, 1] * x[:, 0] < -0.4, 2, 0))
    at = np.arange(len(x)) // 3  # three rows of one time
    own = pd.DataFrame({"instrument": "x", "idx": np.arange(len(x)), "time": pd.to_datetime(at, unit="s"), "target": y, **{c: x[:, i] for i, c in enumerate(COLUMNS)}})
    train_s, test_s = (8_000, 1_000) if not least else (1_000, 900)
    rules = B.Rules(rounds=3, depth=2, keep_every=2, bins=16, rate=0.3)
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, 16) / 16).round(2)) for i in range(3)]
    monkeypatch.setattr(walk, "bin_edges", lambda *_: edges)  # approximate ones depend on how rows are dealt
    out = walk_forward_fits(spark.createDataFrame(own).repartition(3), COLUMNS, "target", train_s, 100, test_s, rules).toPandas()
    assert out["window"].nunique() >= 3
    for w, got in out.groupby("window"):
        part = np.flatnonzero((at >= w * test_s) & (at < w * test_s + train_s))
        assert set(got["n_learned"]) == {len(part)} == {3 * train_s}
        local = B.train_local(x[part], y[part], np.arange(len(part)) >= len(part) * 0.8, COLUMNS, edges, rules)
        assert np.allclose(np.stack(got["p"].to_list()), local.probabilities(x[got["idx"].to_numpy()]))
