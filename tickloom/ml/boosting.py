"""Gradient boosting of several classes on histograms that Spark sums.

Features are cut into bins once, at quantiles. Each round grows one tree a class, level by level: every task sums gradients
and Hessians of its rows by class, node, feature and bin, Spark adds the sums, and the driver picks splits from them. What
reaches the driver has the size of the histogram (classes x nodes x features x bins), whatever the number of rows; rows
carry their scores with them and never move. Boosting stops when the loss on later rows, which no tree learned from, has
not fallen for a number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.scratch import stored

#: Half-grown trees, the nodes of each to be summed, and whether these are roots.
Asked = tuple[list["Tree"], list[list[int]], bool]
#: Sums by cell of the asked nodes, and at the roots the loss of the later rows, null without such rows.
Told = tuple[np.ndarray, "float | None"]


@dataclass
class Rules:
    classes: int = 3
    rounds: int = 20
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    ridge: float = 1.0
    least_hessian: float = 1.0
    patience: int = 5
    #: Rounds after which the scores so far are written to the rows, so that no task applies more trees than that.
    keep_every: int = 5


@dataclass
class Tree:
    """A full tree of some depth: node n has children 2n + 1 and 2n + 2; a node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(nodes))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row (features in bins) ends."""
        at = np.zeros(len(bins), dtype=int)
        for _ in range(len(self.feature).bit_length() - 1):
            feature = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.cut[at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node(bins)]


@dataclass
class Model:
    columns: list[str]
    edges: list[np.ndarray]
    rules: Rules
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        bins = self.binned(values)
        scores = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            scores += np.stack([t.scores(bins) for t in trees], axis=1)
        return softmax(scores)

    def importance(self) -> list[tuple[str, float]]:
        """Columns by the gain of their splits, the greatest first."""
        return sorted(zip(self.columns, self.gains.tolist()), key=lambda x: (-x[1], x[0]))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last, at quantiles of the values; nulls count as 0."""
    shares = [i / bins for i in range(1, bins)]
    found = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).approxQuantile(list(columns), shares, 0.001)
    return [np.unique(np.array(q)) for q in found]


def _grow(sums: np.ndarray, tree: Tree, nodes: Sequence[int], rules: Rules, gains: np.ndarray) -> list[int]:
    """Split the nodes of a level by their histograms (node, feature, bin, (G, H)); returns the nodes that were split."""
    split = []
    for i, node in enumerate(nodes):
        g, h = sums[i, 0, :, 0].sum(), sums[i, 0, :, 1].sum()
        tree.value[node] = -rules.rate * g / (h + rules.ridge)
        left = np.cumsum(sums[i], axis=1)[:, :-1]
        gl, hl = left[..., 0], left[..., 1]
        gain = gl**2 / (hl + rules.ridge) + (g - gl) ** 2 / (h - hl + rules.ridge) - g**2 / (h + rules.ridge)
        gain = np.where((hl >= rules.least_hessian) & (h - hl >= rules.least_hessian), gain, -np.inf)
        best = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)  # of equal gains the first feature and bin
        if gain[best] > 1e-9:
            tree.feature[node], tree.cut[node] = best
            gains[best[0]] += gain[best] / 2
            split.append(node)
    return split


def _boost(model: Model, features: int, keep: Callable[[list[Tree]], None]) -> Generator[Asked, Told, None]:
    """Add rounds of trees until the loss of the later rows has not fallen for ``patience`` rounds, and go back to the best.

    Asks for the sums of nodes of half-grown trees; ``keep`` takes over the trees of a round.
    """
    rules, gains = model.rules, []
    for number in range(rules.rounds + 1):
        trees, nodes = [Tree.of_depth(rules.depth) for _ in range(rules.classes)], [[0] for _ in range(rules.classes)]
        for level in range(rules.depth + 1):
            flat, loss = yield trees, nodes, level == 0
            if level == 0:
                model.losses.append(-number if loss is None else loss)
                gains.append(model.gains.copy())
                best = int(np.argmin(model.losses))
                if number == rules.rounds or number - best >= rules.patience:
                    model.rounds, model.gains = model.rounds[:best], gains[best]
                    return
            starts = _starts(nodes, features, rules)
            sums = [flat[starts[c] : starts[c + 1]].reshape(len(own), features, rules.bins, 2) for c, own in enumerate(nodes)]
            grow = _grow if level < rules.depth else _leaves
            split = [grow(sums[c], trees[c], nodes[c], rules, model.gains) for c in range(rules.classes)]
            nodes = [[child for n in own for child in (2 * n + 1, 2 * n + 2)] for own in split]
            if not any(nodes):
                break
        model.rounds.append(trees)
        keep(trees)


def _starts(nodes: list[list[int]], features: int, rules: Rules) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(own) * features * rules.bins for own in nodes])]).astype(int)


def _add(total: np.ndarray, bins: np.ndarray, p: np.ndarray, y: np.ndarray, trees: list[Tree], nodes: list[list[int]], rules: Rules) -> None:
    """Add gradients and Hessians of rows to the cells (class, node, feature, bin) that they fall in."""
    features = bins.shape[1]
    starts = _starts(nodes, features, rules)
    for c, tree in enumerate(trees):
        if not nodes[c] or not len(bins):
            continue
        place = {n: i for i, n in enumerate(nodes[c])}
        at = np.array([place.get(n, -1) for n in range(len(tree.feature))])[tree.node(bins)]
        within = at >= 0
        key = starts[c] + (at[within, None] * features + np.arange(features)) * rules.bins + bins[within]
        for k, weight in enumerate((p[within, c] - (y[within] == c), p[within, c] * (1 - p[within, c]))):
            total[:, k] += np.bincount(key.ravel(), np.repeat(weight, features), minlength=len(total))


def train(df: DataFrame, columns: Sequence[str], label: str = "target", held_out: str = "held_out", rules: Rules | None = None) -> Model:
    """A model of ``label`` (0 to classes - 1). Rows of which ``held_out`` is true are the later slice that says when to stop.

    Without such rows all rounds are kept. A null feature counts as 0; rows without a label are not learned from.
    """
    rules, columns, known = rules or Rules(), list(columns), df.where(F.col(label).isNotNull())
    edges = bin_edges(known.where(~F.col(held_out)), columns, rules.bins)
    own = known.select(F.lit(0).cast("long").alias("key"), F.col(label).cast("int").alias("y"), F.col(held_out).alias("late"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return train_each(own, [0], columns, edges, rules)[0]


def train_each(df: DataFrame, keys: Sequence[int], columns: Sequence[str], edges: list[np.ndarray], rules: Rules) -> dict[int, Model]:
    """A model of the rows of each key, grown side by side: a pass over all rows sums what every model asks for next.

    ``df`` has key, y (the label), late (the later slice that says when to stop) and the columns, none of them null. What
    reaches the driver is a histogram for each key.
    """
    counts: dict[int, dict[int, int]] = {k: {} for k in keys}
    for r in df.where(~F.col("late")).groupBy("key", "y").count().collect():
        counts[r["key"]][r["y"]] = r["count"]
    models = {}
    for k in keys:
        shares = np.array([counts[k].get(c, 0) + 1.0 for c in range(rules.classes)])
        models[k] = Model(list(columns), edges, rules, np.log(shares / shares.sum()), [], np.zeros(len(columns)))
    starts = df.sparkSession.createDataFrame([(k, [float(v) for v in m.start]) for k, m in models.items()], "key long, s array<double>")
    ready = df.select("key", "y", "late", *[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)]).join(F.broadcast(starts), "key")
    rows = stored(ready.select("key", "y", "late", "s", _bins(ready, models[keys[0]])), "boosted")
    late: dict[int, list[list[Tree]]] = {k: [] for k in keys}
    steps = {k: _boost(m, len(columns), late[k].append) for k, m in models.items()}
    asked = {k: next(step) for k, step in steps.items()}
    while asked:
        if max(len(own) for own in late.values()) >= rules.keep_every:
            rows = stored(_scored(rows, late), "boosted")
            for own in late.values():
                own.clear()
        told, asked = _histograms(rows, late, asked, rules, len(columns)), {}
        for k, answer in told.items():
            try:
                asked[k] = steps[k].send(answer)
            except StopIteration:
                pass
    return models


def train_local(values: np.ndarray, y: np.ndarray, later: np.ndarray, columns: Sequence[str], edges: list[np.ndarray], rules: Rules) -> Model:
    """The same model of rows that are in memory, for groups of bounded size."""
    shares = np.bincount(y[~later], minlength=rules.classes) + 1.0
    model = Model(list(columns), edges, rules, np.log(shares / shares.sum()), [], np.zeros(len(columns)))
    bins = model.binned(values)
    scores = np.tile(model.start, (len(bins), 1))

    def histograms(trees: list[Tree], nodes: list[list[int]], first: bool) -> tuple[np.ndarray, float | None]:
        p = softmax(scores)
        total = np.zeros((_starts(nodes, len(columns), rules)[-1], 2))
        _add(total, bins[~later], p[~later], y[~later], trees, nodes, rules)
        return total, float(-np.log(np.maximum(p[later, y[later]], 1e-15)).mean()) if first and later.any() else None

    def keep(trees: list[Tree]) -> None:
        scores[:] += np.stack([t.scores(bins) for t in trees], axis=1)

    steps = _boost(model, len(columns), keep)
    asked = next(steps)
    while True:
        try:
            asked = steps.send(histograms(*asked))
        except StopIteration:
            return model


def _leaves(sums: np.ndarray, tree: Tree, nodes: Sequence[int], rules: Rules, _: np.ndarray) -> list[int]:
    for i, node in enumerate(nodes):
        g, h = sums[i, 0].sum(axis=0)
        tree.value[node] = -rules.rate * g / (h + rules.ridge)
    return []


def _bins(df: DataFrame, model: Model):
    def cut(*values: pd.Series) -> pd.Series:
        return pd.Series(list(model.binned(np.stack([v.to_numpy() for v in values], axis=1)).astype(np.int16)))

    return F.pandas_udf(cut, "array<short>")(*[f"x{i}" for i in range(len(model.columns))]).alias("b")


def _each(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """The keys of a batch, each with the places of its rows."""
    keys = batch["key"].to_numpy()
    for key in np.unique(keys):
        yield int(key), np.flatnonzero(keys == key)


def _scored(rows: DataFrame, late: dict[int, list[list[Tree]]]) -> DataFrame:
    """The rows with the scores of further trees added."""
    late = {k: list(own) for k, own in late.items()}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            bins, scores = np.stack(batch["b"].to_list()), np.stack(batch["s"].to_list())
            for key, at in _each(batch):
                for trees in late[key]:
                    scores[at] += np.stack([t.scores(bins[at]) for t in trees], axis=1)
            yield batch.assign(s=list(scores))

    return rows.mapInPandas(add, rows.schema)


def _histograms(rows: DataFrame, late: dict[int, list[list[Tree]]], asked: dict[int, Asked], rules: Rules, features: int) -> dict[int, Told]:
    """Sums (G, H) by cell of the rows that are learned from, for each key that asks; at roots also the mean loss of the others."""
    cells = {k: int(_starts(nodes, features, rules)[-1]) for k, (_, nodes, _) in asked.items()}
    late = {k: list(late[k]) for k in asked}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, losses = {}, {}
        for batch in batches:
            for key, at in _each(batch):
                if key not in asked:
                    continue
                trees, nodes, first = asked[key]
                part = batch.iloc[at]
                bins, scores = np.stack(part["b"].to_list()).astype(int), np.stack(part["s"].to_list())
                for past in late[key]:
                    scores = scores + np.stack([t.scores(bins) for t in past], axis=1)
                p, y, later = softmax(scores), part["y"].to_numpy(), part["late"].to_numpy(dtype=bool)
                total, loss = totals.setdefault(key, np.zeros((cells[key], 2))), losses.setdefault(key, np.zeros(2))
                if first:
                    loss += -np.log(np.maximum(p[later, y[later]], 1e-15)).sum(), later.sum()
                _add(total, bins[~later], p[~later], y[~later], trees, nodes, rules)
        for key, total in totals.items():
            used = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"key": key, "cell": np.append(used, -1), "g": np.append(total[used, 0], losses[key][0]), "h": np.append(total[used, 1], losses[key][1])})

    found = rows.mapInPandas(add, "key long, cell long, g double, h double").groupBy("key", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    told = {}
    for key in asked:
        flat, own = np.zeros((cells[key], 2)), found[found["key"] == key]
        sums, rest = own[own["cell"] >= 0], own[own["cell"] < 0][["g", "h"]].sum()
        flat[sums["cell"].to_numpy()] = sums[["g", "h"]].to_numpy()
        told[key] = flat, float(rest["g"] / rest["h"]) if rest["h"] else None
    return told


def score(model: Model, df: DataFrame) -> DataFrame:
    """The rows with ``p``, the probability of each class."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(*values: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.probabilities(np.stack([v.to_numpy() for v in values], axis=1))))

    return df.withColumn("p", F.pandas_udf(judge, "array<double>")(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.columns]))
