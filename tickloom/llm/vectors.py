"""Nearest neighbours by inner product over sharded small-world graphs.

Distinct vectors are grouped by length and by a band of norms (largest to smallest at most 16 to 1), and each
group is cut into about ``SHARDS`` shards, more where they would grow beyond ``SHARD_COMPONENTS``. Each shard is a hierarchical navigable small-world graph, built
once and stored as flat neighbour arrays; queries are sent to shards in bounded chunks, and the shards' best
are merged by rank. Inner product becomes Euclidean distance by one more coordinate, sqrt(R^2 - |x|^2) with
R the largest norm of the shard; vectors are divided by R first, so neither one long vector nor many short
ones blur the rest. Returned scores are exact inner products of the original vectors in double precision.

A group of more than one shard is cut along cells of a k-means fit on a bounded sample (``CELL_SAMPLE`` vectors a
cell, at most ``MAX_CELLS`` cells), and a query visits the cells whose centre comes within a margin of its best
one. The margin is fitted too: for ``PROBES`` queries the true neighbours are found by brute force over all
rows, and the margin is the smallest that reaches the cells of ``ROUTED`` of them. Clustered data thus
needs few cells and structureless data most; the recall is kept either way. Every row is indexed.

Defined cases: rows that share one vector are one graph node; of their ids the ``k + 1`` smallest are kept, more
can never be among the ``k`` nearest of a query. Vectors that are null, zero, or hold a null or non-finite
component take no part. Only vectors of one length are compared. Each query row has its own ``k`` nearest,
also where ids repeat; repeated ids count as different rows, and a query leaves out one row of its own id and
vector. Ties go to the smaller id; null ids take no part; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, small, split_join

NEAREST = 20
#: A group of vectors is cut into about ``SHARDS`` shards, of ``SHARD_ROWS`` vectors at least and ``SHARD_COMPONENTS`` components at most.
SHARD_ROWS, SHARDS, SHARD_COMPONENTS = 4096, 16, 1 << 22
LINKS = 12
BUILD_WIDTH = 64
#: The beam of a search is ``WIDTH_GROWTH`` times the root of the shard's vectors wide, and ``SEARCH_WIDTH`` at least.
SEARCH_WIDTH, WIDTH_GROWTH = 128, 2.0
SEED = 3
#: Points that are inserted at once, points of a beam whose neighbours are looked at in one step, width of beams above the layer.
INSERTED, EXPANDED, DESCENT_WIDTH = 1024, 8, 16
#: Marks of the points that the beams of one step have met, a byte each.
MET_BYTES = 16 << 20
#: Components of found vectors that are scored at once.
SCORED = 1 << 22
#: log2 of the ratio of norms within one band.
BAND_BITS = 4
#: Queries in one task of one shard.
CHUNK_QUERIES = 16_000
#: Shards of at most this many vectors are searched whole.
WHOLE = 256
MAX_CELLS, CELL_SAMPLE, CELL_ROUNDS, MAX_ROUTED_GROUPS = 1024, 64, 6, 64
PROBES, ROUTED = 256, 0.97
SMALL_ROWS = 100_000


_NONE, _LAST = np.uint64(2**64 - 1), np.uint64(1)


def _keys(gaps: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Distances and numbers as integers that sort by distance; the last bit tells whether the neighbours were looked at."""
    high = np.maximum(gaps, 0).astype(np.float32).view(np.uint32).astype(np.uint64)
    return (high << np.uint64(32)) | (numbers.astype(np.uint64) << _LAST)


def _numbers(keys: np.ndarray) -> np.ndarray:
    return ((keys & np.uint64(2**32 - 1)) >> _LAST).astype(np.int64)


class Graph:
    """Hierarchical small-world graph over rows of ``points``; ``flat[layer]`` holds neighbour numbers, -1 where free.

    Points come in an order that has nothing to do with where they lie: layer ``l`` holds the first n / ``links`` ** l
    of them. Points are inserted, and queries answered, many at a time, each with a beam of its own.
    """

    @classmethod
    def stored(cls, points: np.ndarray, heights: np.ndarray, flat: list[bytes], entry: int, links: int = LINKS) -> Graph:
        """A graph from its flat neighbour arrays."""
        own = cls.__new__(cls)
        own._lay_out(points, heights, links)
        own.flat = [np.frombuffer(f, dtype=np.int32).reshape(n, -1) for f, n in zip(flat, own.sizes)]
        own.entry = entry
        return own

    def __init__(self, points: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH):
        n, sizes = len(points), [len(points)]
        while sizes[-1] > 4 * links:
            sizes.append(-(-sizes[-1] // links))
        heights = np.zeros(n, dtype=np.int8)
        for layer, size in enumerate(sizes[1:], 1):
            heights[:size] = layer
        self._lay_out(points, heights, links)
        self.flat = [np.full((size, (3 if layer else 4) * links), -1, dtype=np.int32) for layer, size in enumerate(self.sizes)]
        self.degree = [np.zeros(size, dtype=np.int32) for size in self.sizes]
        self.entry = 0 if n else -1
        for layer in range(len(self.sizes) - 1, -1, -1):
            above = self.sizes[layer + 1] if layer + 1 < len(self.sizes) else self.sizes[layer]
            for start in range(0, above, INSERTED):
                self._insert(start, min(start + INSERTED, above), 0, above, width, layer)
            for start in range(above, self.sizes[layer], INSERTED):
                end = min(start + INSERTED, self.sizes[layer])
                self._insert(start, end, start, end, width, layer)

    def _lay_out(self, points: np.ndarray, heights: np.ndarray, links: int) -> None:
        self.heights, self.links = heights, links
        self.points = np.ascontiguousarray(points, dtype=np.float32)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.sizes = [int((heights >= layer).sum()) for layer in range(int(heights.max()) + 1)] if len(points) else []

    def _gaps(self, numbers: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distances of the points in each row of ``numbers`` from that row of ``q``."""
        inner = np.matmul(np.take(self.points, numbers, axis=0), q[:, :, None])[:, :, 0]
        return np.take(self.norms, numbers) + np.einsum("ij,ij->i", q, q)[:, None] - 2 * inner

    def _search(self, q: np.ndarray, begin: np.ndarray, width: int, layer: int) -> np.ndarray:
        """Keys of the ``width`` nearest found for each row of ``q`` from its row of ``begin``, nearest first."""
        n, flat = self.sizes[layer], self.flat[layer]
        met = np.zeros(len(q) * n, dtype=bool)
        met[(np.arange(len(q))[:, None] * n + begin)[begin >= 0]] = True
        beam = np.full((len(q), max(width, begin.shape[1])), _NONE)
        beam[:, : begin.shape[1]] = np.where(begin < 0, _NONE, _keys(self._gaps(np.maximum(begin, 0), q), np.maximum(begin, 0)))
        beam = np.sort(beam, axis=1)[:, :width]
        active = np.arange(len(q))
        while len(active):
            own = beam[active]
            fresh = np.where(own & _LAST, _NONE, own)
            nth = min(EXPANDED, width) - 1
            row, col = np.nonzero((fresh <= np.partition(fresh, nth, axis=1)[:, nth : nth + 1]) & (fresh != _NONE))
            around = np.take(flat, _numbers(own[row, col]), axis=0)
            own[row, col] |= _LAST
            places = ((active[row] * n)[:, None] + around)[around >= 0]
            places = np.sort(places[~np.take(met, places)])
            places = places[np.append(True, places[1:] != places[:-1])[: len(places)]]
            met[places] = True
            row, number = np.divmod(places, n)
            row = np.searchsorted(active, row)
            count = np.bincount(row, minlength=len(active))
            if len(row):
                slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                some = np.zeros((len(active), int(count.max())), dtype=np.int64)
                some[row, slot] = number
                keys = _keys(self._gaps(some, q[active]), some)
                keys[np.arange(some.shape[1]) >= count[:, None]] = _NONE
                own = np.partition(np.hstack([own, keys]), width - 1, axis=1)[:, :width]
            beam[active] = own
            active = active[((own & _LAST) == 0).any(axis=1)]
        return np.sort(beam, axis=1)

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """Where to begin in a layer: what narrow beams find in the layer above, -1 where they find less."""
        begin = np.full((len(q), 1), self.entry, dtype=np.int64)
        for above in range(len(self.sizes) - 1, layer, -1):
            keys = self._search(q, begin, DESCENT_WIDTH, above)
            begin = np.where(keys == _NONE, -1, _numbers(keys))
        return begin

    def _found(self, q: np.ndarray, width: int, layer: int) -> np.ndarray:
        """Keys of the ``width`` nearest found for each row of ``q``, some rows at a time so that little memory is needed."""
        step = max(1, min(INSERTED // 2, MET_BYTES // max(1, self.sizes[layer])))
        parts = [q[i : i + step] for i in range(0, len(q), step)]
        return np.concatenate([self._search(part, self._descend(part, layer), width, layer) for part in parts])

    def _insert(self, start: int, end: int, low: int, high: int, width: int, layer: int) -> None:
        """Link the points ``start`` to ``end`` to near ones: those of ``low`` to ``high``, and found ones before ``low``."""
        q = self.points[start:end]
        gaps = self.norms[start:end, None] + self.norms[None, low:high] - 2 * (q @ self.points[low:high].T)
        keys = _keys(gaps, np.broadcast_to(np.arange(low, high), gaps.shape))
        keys[np.arange(end - start), np.arange(start - low, end - low)] = _NONE
        if high - low > width:
            keys = np.partition(keys, width - 1, axis=1)[:, :width]
        if low:
            keys = np.hstack([keys, self._found(q, width, layer)])
        keys = np.sort(keys, axis=1)[:, :width]
        chosen = self._spread(keys, self.links)
        row, col = np.nonzero(chosen != _NONE)
        near = _numbers(chosen[row, col])
        both = np.unique(np.concatenate([(row + start) * len(self.points) + near, near * len(self.points) + row + start]))
        self._link(*np.divmod(both, len(self.points)), layer)

    def _spread(self, keys: np.ndarray, most: int) -> np.ndarray:
        """Of each row's keys, nearest first, those nearer to the point than to any chosen before; filled up with the rest."""
        out = []
        for part in (keys[i : i + 256] for i in range(0, len(keys), 256)):
            numbers = np.where(part == _NONE, 0, _numbers(part))
            some, norms = np.take(self.points, numbers, axis=0), np.take(self.norms, numbers)
            between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(some, some.transpose(0, 2, 1))
            own = np.where(part == _NONE, np.uint64(0x7F800000), part >> np.uint64(32)).astype(np.uint32).view(np.float32)
            closest, chosen = np.full(part.shape, np.inf, dtype=np.float32), np.zeros(part.shape, dtype=bool)
            count = np.zeros(len(part), dtype=np.int64)
            for k in range(part.shape[1]):
                row = np.flatnonzero((own[:, k] < closest[:, k]) & (count < most))
                chosen[row, k] = True
                count[row] += 1
                closest[row] = np.minimum(closest[row], between[row, k])
            rest = np.cumsum(~chosen & (part != _NONE), axis=1) <= np.maximum(0, most // 2 - count)[:, None]
            out.append(np.sort(np.where(chosen | rest, part, _NONE), axis=1)[:, :most])
        return np.concatenate(out)

    def _link(self, source: np.ndarray, target: np.ndarray, layer: int) -> None:
        """Add links, sorted by source; a point without room for its new ones keeps those that ``_spread`` chooses."""
        flat, degree = self.flat[layer], self.degree[layer]
        new = ~(np.take(flat, source, axis=0) == target[:, None]).any(axis=1)
        source, target = source[new], target[new]
        points, count = np.unique(source, return_counts=True)
        slot = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        room, fits = flat.shape[1], degree[points] + count <= flat.shape[1]
        easy = np.repeat(fits, count)
        flat[source[easy], degree[source[easy]] + slot[easy]] = target[easy]
        degree[points[fits]] += count[fits].astype(np.int32)
        full, most = points[~fits], self.links * (1 if layer else 2)
        if not len(full):
            return
        wide = np.full((len(full), room + int(count[~fits].max())), -1, dtype=np.int64)
        wide[:, :room] = flat[full]
        wide[np.repeat(np.arange(len(full)), count[~fits]), room + slot[~easy]] = target[~easy]
        for i in range(0, len(full), 256):
            own, some = full[i : i + 256], wide[i : i + 256]
            keys = _keys(self._gaps(np.maximum(some, 0), self.points[own]), np.maximum(some, 0))
            keys = np.sort(np.where(some < 0, _NONE, keys), axis=1)[:, : 2 * room]
            kept = self._spread(keys, most)
            flat[own] = -1
            flat[own, : kept.shape[1]] = np.where(kept == _NONE, -1, _numbers(kept))
            degree[own] = (kept != _NONE).sum(axis=1)

    def nearest_all(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Numbers of the ``width`` nearest found for each row of ``q``, nearest first, -1 where there are fewer."""
        if self.entry < 0:
            return np.full((len(q), width), -1)
        keys = self._found(np.ascontiguousarray(q, dtype=np.float32), width, 0)
        return np.where(keys == _NONE, -1, _numbers(keys))

    def nearest(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> list[int]:
        found = self.nearest_all(q[None, :], width)[0]
        return found[found >= 0].tolist()


def _norm(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


class Shard:
    """The vectors of one shard with their graph; answers queries by exact scores of what the graph finds."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, ends: np.ndarray, graph: Graph | None):
        self.vectors, self.ids, self.starts, self.ends, self.graph = vectors, ids, np.concatenate([[0], ends[:-1]]), ends, graph

    @staticmethod
    def points(vectors: np.ndarray) -> np.ndarray:
        """Vectors over the largest norm, with the coordinate that makes all norms 1."""
        radius = float(_norm(vectors / np.abs(vectors).max())[:].max() * np.abs(vectors).max())
        scaled = vectors / radius
        lift = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", scaled, scaled), 0))
        return np.hstack([scaled, lift[:, None]])

    def answers(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the ``k`` nearest found of each query: its place in ``queries``, their ids and scores."""
        n = len(self.vectors)
        width = n if self.graph is None else max(SEARCH_WIDTH, 2 * k, int(WIDTH_GROWTH * n**0.5))
        if self.graph is None:
            found = np.broadcast_to(np.arange(n), (len(queries), n))
        else:
            found = self.graph.nearest_all(np.hstack([_directions(queries), np.zeros((len(queries), 1))]), width)
        step, out = max(1, SCORED // (width * queries.shape[1])), []
        for i in range(0, len(queries), step):
            row, ids, scores = self._ranked(found[i : i + step], query_ids[i : i + step], queries[i : i + step], k)
            out.append((row + i, ids, scores))
        return tuple(np.concatenate(column) for column in zip(*out))

    def _ranked(self, found: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the found nodes by exact score, less one row of each query's own id and vector."""
        scores = np.matmul(np.take(self.vectors, found, axis=0).astype(np.float64), q[:, :, None])[:, :, 0]
        scores[found < 0] = -np.inf
        best = np.lexsort((self.ids[self.starts[found]], -scores), axis=1)[:, : 2 * k + 1]
        nodes, scores = np.take_along_axis(found, best, axis=1), np.take_along_axis(scores, best, axis=1)
        row, col = np.nonzero(nodes >= 0)
        node, score = nodes[row, col], scores[row, col]
        count = self.ends[node] - self.starts[node]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row, node, score = np.repeat(row, count), np.repeat(node, count), np.repeat(score, count)
        ids = self.ids[self.starts[node] + nth]
        own = np.flatnonzero(ids == query_ids[row])
        own = own[(self.vectors[node[own]] == q[row[own]]).all(axis=1)]
        keep = np.ones(len(ids), dtype=bool)
        keep[own[np.unique(row[own], return_index=True)[1]]] = False
        row, ids, score = row[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        count = np.bincount(row, minlength=len(q))
        first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < k
        return row[first], ids[first], score[first]


SHARD_SCHEMA = "shard string, n int, item int, vectors binary, ids array<long>, ends array<int>, heights binary, flat array<binary>, entry int"


def _stored(shard: str, vectors: list[np.ndarray], ids: list[np.ndarray]) -> dict:
    """One row for a shard: its vectors, their ids and the graph."""
    matrix = np.stack(vectors).astype(np.float64)
    graph = Graph(Shard.points(matrix)) if len(matrix) > WHOLE else None
    with np.errstate(over="ignore"):
        single = matrix.astype(np.float32)
    kept = single if np.array_equal(single, matrix) else matrix
    return {
        "shard": shard,
        "n": len(matrix),
        "item": kept.itemsize,
        "vectors": kept.tobytes(),
        "ids": np.concatenate(ids).astype(np.int64),
        "ends": np.cumsum([len(i) for i in ids]).astype(np.int32),
        "heights": graph.heights.tobytes() if graph else None,
        "flat": [f.tobytes() for f in graph.flat] if graph else [],
        "entry": graph.entry if graph else -1,
    }


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams nodes sorted by shard into one row for each shard."""
    shard, vectors, ids = None, [], []
    for batch in batches:
        for name, own, vector in zip(batch["shard"].tolist(), batch["ids"], batch["vector"]):
            if name != shard:
                if vectors:
                    yield pd.DataFrame([_stored(shard, vectors, ids)])
                shard, vectors, ids = name, [], []
            vectors.append(np.asarray(vector))
            ids.append(np.sort(own))
    if vectors:
        yield pd.DataFrame([_stored(shard, vectors, ids)])


def _loaded(row: dict) -> Shard:
    vectors = np.frombuffer(row["vectors"], dtype=np.dtype(f"f{int(row['item'])}")).reshape(int(row["n"]), -1)
    graph = None
    if row["heights"] is not None:
        graph = Graph.stored(Shard.points(vectors.astype(np.float64)), np.frombuffer(row["heights"], dtype=np.int8), list(row["flat"]), int(row["entry"]))
    return Shard(vectors, np.asarray(row["ids"]), np.asarray(row["ends"]), graph)


def _searcher(k: int):
    """Streams rows sorted by shard and chunk, the shard's graph before its queries; one graph is in memory at a time."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = None
        for batch in batches:
            for _, part in batch.groupby((batch["side"].diff().fillna(0) != 0).cumsum().to_numpy()):
                if part["side"].iloc[0] == 0:
                    loaded = _loaded(part.iloc[-1].to_dict())
                    continue
                query_ids = part["query_id"].to_numpy()
                row, ids, scores = loaded.answers(query_ids, np.stack(part["vector"].tolist()), k)
                yield pd.DataFrame({"query_row": part["query_row"].to_numpy()[row], "query_id": query_ids[row], "vec_id": ids, "score": scores})

    return search


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _band(vector: Column) -> Column:
    """Number of the band of norms, norm 1 in the middle of band 0; components are divided by the largest, so that no square overflows."""

    def of(most: Column) -> Column:
        square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / most) * (x / most))
        return F.floor((F.log2(most) + F.log2(square) / 2) / BAND_BITS + 0.5).cast("int")

    # As the variable of a transform, the largest component is found once a vector and not once a component.
    return F.transform(F.array(F.array_max(F.transform(vector, F.abs))), of)[0]


def cells_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of ``count`` cells of unit vectors or shorter ones: k-means, with empty cells left where they were."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(CELL_ROUNDS):
        own = cell_of(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        sizes = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def cell_of(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres)).argmax(axis=1)


def _directions(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / _norm(vectors)[:, None]


def _fit_cells(nodes: DataFrame, groups: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centres of the directions of each group of more than one shard, from a bounded sample of its vectors."""
    large = groups.where(F.col("n") > F.col("shard_rows")).orderBy(F.desc("n"), "size", "band").limit(MAX_ROUTED_GROUPS).collect()
    out = {}
    for g in large:
        count = min(MAX_CELLS // len(large) + 1, -(-g["n"] // g["shard_rows"]))
        most = count * CELL_SAMPLE
        share = min(1.0, 2 * most / g["n"])
        drawn = F.pmod(F.xxhash64("vector", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))
        rows = nodes.where((F.col("size") == g["size"]) & (F.col("band") == g["band"]) & drawn).select("vector").limit(most).collect()
        out[g["size"], g["band"]] = cells_of(_directions(np.array([r[0] for r in rows])), count)
    return out


def _assigner(cells: dict[tuple[int, int], np.ndarray]):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"] = 0
            for key, part in batch.groupby(["size", "band"]):
                if key in cells and len(part):
                    batch.loc[part.index, "cell"] = cell_of(_directions(np.stack(part["vector"].tolist())), cells[key])
            yield batch

    return assign


def _gaps(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How much less each cell's centre agrees with each query than its best one."""
    agreement = _directions(q) @ centres.T
    return agreement.max(axis=1, keepdims=True) - agreement


def _fit_margin(nodes: DataFrame, queries: DataFrame, cells: dict[tuple[int, int], np.ndarray], k: int) -> float:
    """The margin within which the cells of the true neighbours of a bounded sample of queries lie."""
    chosen = queries.select("query_row", "size", "vector").orderBy(F.xxhash64("query_row")).limit(PROBES).collect()
    by_size: dict[int, tuple[list[int], np.ndarray]] = {}
    for size in {r["size"] for r in chosen}:
        own = [r for r in chosen if r["size"] == size]
        by_size[size] = ([r["query_row"] for r in own], np.array([r["vector"] for r in own]))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (size, band), part in batch.groupby(["size", "band"]):
                if size not in by_size or not len(part):
                    continue
                numbers, q = by_size[size]
                scores = q @ np.stack(part["vector"].tolist()).T
                top = np.argpartition(-scores, min(k, len(part) - 1), axis=1)[:, : k + 1]
                yield pd.DataFrame(
                    {
                        "query_row": np.repeat(numbers, top.shape[1]),
                        "size": size,
                        "band": band,
                        "cell": part["cell"].to_numpy()[top].ravel(),
                        "score": np.take_along_axis(scores, top, axis=1).ravel(),
                    }
                )

    found = nodes.select("size", "band", "cell", "vector").mapInPandas(best, "query_row long, size int, band int, cell int, score double")
    window = Window.partitionBy("query_row").orderBy(F.desc("score"))
    true = found.withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= k + 1).collect()
    vectors = {r["query_row"]: np.asarray(r["vector"]) for r in chosen}
    needed = [_gaps(vectors[r["query_row"]][None, :], cells[r["size"], r["band"]])[0, r["cell"]] for r in true if (r["size"], r["band"]) in cells]
    return float(np.quantile(needed, ROUTED, method="higher")) if needed else 0.0


def _router(cells: dict[tuple[int, int], np.ndarray], margin: float):
    """Rows (query, group) become one row for each cell that the query visits."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(["size", "band"]):
                if key not in cells or not len(part):
                    yield part.assign(cell=0)
                    continue
                near = _gaps(np.stack(part["vector"].tolist()), cells[key]) <= margin + 1e-9
                row, cell = np.nonzero(near)
                yield part.iloc[row].assign(cell=cell)

    return route


def nearest(table: DataFrame, is_query: Column, *, k: int = NEAREST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's ``k`` nearest rows but itself, with query_row.

    ``table`` has vec_id and embedding; ``is_query`` is a condition on vec_id; ``query_row`` tells rows of one id apart.
    """
    vector = F.col("vector")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(vector), F.lit(False)))
    rows = rows.withColumns({"size": F.size(vector), "band": _band(vector)})
    queries = materialise(rows.where(is_query).drop("band").withColumnRenamed("vec_id", "query_id").withColumn("query_row", F.monotonically_increasing_id()), "queries")
    # A hash before the vector, as arrays are slow to sort by.
    same = Window.partitionBy("mark", "vector").orderBy("vec_id")
    marked = rows.withColumn("mark", F.xxhash64(F.transform(vector, lambda x: x + F.lit(0.0))))
    few = marked.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    nodes = materialise(few.groupBy("mark", "vector", "size", "band").agg(F.collect_list("vec_id").alias("ids")).drop("mark"), "nodes")
    most = F.least(F.ceil(F.col("n") / SHARDS), F.floor(F.lit(SHARD_COMPONENTS) / F.col("size")))
    groups = nodes.groupBy("size", "band").agg(F.count("*").alias("n")).withColumn("shard_rows", F.greatest(F.lit(shard_rows), most))
    groups = materialise(groups, "groups")
    cells = _fit_cells(nodes, groups)
    if cells:
        nodes = materialise(nodes.mapInPandas(_assigner(cells), "vector array<double>, size int, band int, ids array<long>, cell int"), "celled")
    else:
        nodes = nodes.withColumn("cell", F.lit(0))
    margin = _fit_margin(nodes, queries, cells, k) if cells else 0.0

    names = ["size", "band", "cell"]
    held = nodes.groupBy(*names).agg(F.count("*").alias("held")).join(small(groups, SMALL_ROWS).drop("n"), ["size", "band"])
    subs = F.greatest(F.lit(1), F.round(F.col("held") / F.col("shard_rows"))).cast("int")
    parts = materialise(held.select(*names, subs.alias("subs")), "cells")
    cell_name, shard = F.concat_ws("/", *names), F.concat_ws("/", *names, "sub")
    named = parts.select(cell_name.alias("place"), "subs")
    placed = split_join(nodes.withColumn("place", cell_name), named, "place", "vector")
    dealt = placed.withColumn("sub", F.pmod(F.xxhash64("vector"), F.col("subs"))).select(shard.alias("shard"), "ids", "vector")
    shards = max(1, parts.agg(F.sum("subs")).first()[0] or 0)
    index = materialise(dealt.repartition(min(3 * shards, 20_000), "shard").sortWithinPartitions("shard", F.xxhash64("vector", F.lit(SEED))).mapInPandas(_build, SHARD_SCHEMA), "graphs")

    met = queries.join(small(groups, SMALL_ROWS).select("size", "band"), "size").select("query_row", "query_id", "vector", "size", "band")
    visits = met.mapInPandas(_router(cells, margin), "query_row long, query_id long, vector array<double>, size int, band int, cell int")
    visits = visits.withColumn("place", cell_name).join(small(parts, SMALL_ROWS).select(cell_name.alias("place"), "subs"), "place")
    visits = visits.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(shard.alias("shard"), "query_row", "query_id", "vector")
    visits = materialise(visits, "visits")
    chunks = materialise(visits.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks")), "chunks")
    own = split_join(visits, chunks, "shard", "query_row").withColumn("chunk", F.pmod(F.xxhash64("query_row"), F.col("chunks")).cast("int")).drop("chunks")
    copies = index.join(small(chunks, SMALL_ROWS), "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    tasks = max(1, chunks.agg(F.sum("chunks")).first()[0] or 0)
    both = copies.withColumn("side", F.lit(0)).unionByName(own.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.na.fill(0, ["n", "item", "entry", "query_row", "query_id"]).repartition(min(3 * tasks, 20_000), "shard", "chunk")
    streamed = both.sortWithinPartitions("shard", "chunk", "side", "query_row")
    found = streamed.mapInPandas(_searcher(k), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")
