"""The vector search on unequal norms, repeated ids, several lengths, and routed shards."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>"


def table_of(spark, data, ids=None):
    return spark.createDataFrame([(int(i), v.astype(np.float32).tolist()) for i, v in zip(range(len(data)) if ids is None else ids, data)], SCHEMA)


def recall(found, data, step=20, k=20):
    got, exact = defaultdict(list), data.astype(np.float32).astype(np.float64)
    for r in found.collect():
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for q in range(0, len(data), step):
        scores = exact @ exact[q]
        want = sorted((i for i in range(len(data)) if i != q), key=lambda i: (-scores[i], i))[:k]
        hits += len(set(want) & set(got[q]))
        total += len(want)
    return hits / total


@pytest.mark.parametrize("factor", [1e4, 1e6])
def test_one_long_vector_does_not_blur_the_rest(spark, factor):
    data = np.random.default_rng(1).normal(size=(2000, 16))
    data[77] *= factor
    assert recall(vectors.nearest(table_of(spark, data), F.col("vec_id") % 20 == 0), data) >= 0.95


def test_norms_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(2000, 16)) * 10 ** rng.uniform(-6, 6, (2000, 1))
    assert recall(vectors.nearest(table_of(spark, data), F.col("vec_id") % 20 == 0), data) >= 0.95


def test_routed_to_some_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24)) * 2
    data = np.vstack([centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 24)) * 0.4, rng.normal(size=(1000, 24))])
    found = vectors.nearest(table_of(spark, data), F.col("vec_id") % 20 == 0, shard_rows=400)
    assert recall(found, data) >= 0.95


def test_each_query_row_has_its_own_neighbours(spark):
    data = np.random.default_rng(4).normal(size=(300, 8))
    ids = [*range(299), 0]
    data[299] = data[0]
    rows = vectors.nearest(table_of(spark, data, ids), F.col("vec_id") == 0).collect()
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.query_row].append((r["rank"], r.vec_id))
    assert len(by_row) == 2
    for found in by_row.values():
        assert [n for n, _ in sorted(found)] == list(range(1, 21)) and len({i for _, i in found}) == 20
    other = data.copy()
    other[299] = -data[0]
    both = vectors.nearest(table_of(spark, other, ids), F.col("vec_id") == 0).collect()
    assert len(both) == 40


def test_lengths_do_not_mix_and_none_is_dropped(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).astype(np.float32).tolist()) for i in range(90)]
    found = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    length = {i: len(v) for i, v in rows}
    assert {r.query_id for r in found} == {0, 20, 40, 60, 80}
    assert all(length[r.query_id] == length[r.vec_id] for r in found) and len(found) == 25


def test_stored_graph_is_the_graph():
    points = np.random.default_rng(6).normal(size=(600, 9))
    graph = vectors.Graph(points)
    again = vectors.Graph.stored(points, graph.heights, [f.tobytes() for f in graph.flat], graph.entry)
    q = points[5].astype(np.float32)
    assert graph.nearest(q) == again.nearest(q)


def test_large_finite_values(spark):
    data = np.random.default_rng(7).normal(size=(60, 4)) * 1e37
    assert vectors.nearest(table_of(spark, data), F.col("vec_id") == 0).count() == 20


def test_shards_do_not_multiply_with_the_table(spark, monkeypatch):
    data = np.random.default_rng(8).normal(size=(3000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows, write = {}, vectors.materialise

    def counted(df, label, **more):
        made = write(df, label, **more)
        rows[label] = made.count()
        return made

    monkeypatch.setattr(vectors, "materialise", counted)
    found = vectors.nearest(table_of(spark, data), F.col("vec_id") % 20 == 0, shard_rows=50)
    assert recall(found, data) >= 0.95
    assert 2 <= rows["graphs"] <= 2 * 16 and rows["visits"] <= 150 * 2 * 16


def test_queries_together_find_what_each_finds():
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(size=(2500, 12)), 40 + rng.normal(size=(500, 12))])
    rng.shuffle(points)
    graph, q = vectors.Graph(points), points[:60].astype(np.float32)
    together = graph.nearest_all(q)
    exact = np.argsort(((points[None, :, :] - points[:60, None, :]) ** 2).sum(axis=2), axis=1)[:, :20]
    for i in range(60):
        assert together[i].tolist() == graph.nearest(q[i]) and len(set(together[i])) == vectors.SEARCH_WIDTH
    assert np.mean([len(set(t) & set(e)) / 20 for t, e in zip(together.tolist(), exact.tolist())]) >= 0.97
