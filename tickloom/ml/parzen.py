"""Search of parameters by the densities of good and bad trials, and a search inside each trial of another.

A trial is a handful of numbers; the driver keeps them all and draws the next ones. What a trial costs is its evaluation
over rows, and that is Spark's: the trials of a round are evaluated together, in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOOD = 0.25
#: Trials that are drawn uniformly before densities are of use.
START = 8
CANDIDATES = 24
#: Score of a trial that is rejected.
REJECTED = -10.0


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    whole: bool = False

    def fit(self, value: float) -> float:
        return float(round(value)) if self.whole else float(value)


@dataclass
class Trial:
    params: dict[str, float]
    score: float
    #: The best trial of the search inside this one.
    inner: list[Trial] | None = None


class Parzen:
    """Draws parameters, each on its own: uniformly at first, ``START`` trials or more, then where good trials are dense and others are not.

    The best quarter of the trials is good. Each of both sets gives a mixture of normal densities around its values, as
    wide as the gap to the neighbours (at least the range over the number of values, or a fiftieth), and the uniform one. Candidates come from the
    good mixture; the one with the greatest ratio of good to other density is taken. What was drawn for a round counts
    among the others until it is judged, so that a round is not drawn all in one place.
    """

    def __init__(self, space: dict[str, Range], seed: int):
        self.space, self.rng = space, np.random.default_rng(seed)

    def draw(self, trials: Sequence[Trial], n: int) -> list[dict[str, float]]:
        if len(trials) < START:
            return [{k: r.fit(self.rng.uniform(r.low, r.high)) for k, r in self.space.items()} for _ in range(n)]
        ranked = sorted(trials, key=lambda t: -t.score)
        cut = max(1, int(np.ceil(GOOD * len(ranked))))
        good, other = [t.params for t in ranked[:cut]], [t.params for t in ranked[cut:]]
        for _ in range(n):
            other.append({k: self._one(k, r, good, other) for k, r in self.space.items()})
        return other[-n:]

    def _one(self, name: str, within: Range, good: Sequence[dict], other: Sequence[dict]) -> float:
        near, far = (kernels([p[name] for p in some], within) for some in (good, other))
        which = self.rng.integers(0, len(near[0]) + 1, CANDIDATES)
        drawn = self.rng.uniform(within.low, within.high, CANDIDATES)
        noise = self.rng.standard_normal(CANDIDATES)
        own = which < len(near[0])
        drawn[own] = np.clip(near[0][which[own]] + noise[own] * near[1][which[own]], within.low, within.high)
        ratio = np.log(density(drawn, *near, within)) - np.log(density(drawn, *far, within))
        return within.fit(drawn[int(np.argmax(ratio))])


def kernels(values: Sequence[float], within: Range) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths."""
    centres = np.sort(np.array(values, dtype=float))
    edges = np.concatenate([[within.low], centres, [within.high]])
    gaps = np.maximum(np.diff(edges)[:-1], np.diff(edges)[1:]) if len(centres) else np.zeros(0)
    span = within.high - within.low
    return centres, np.clip(gaps, max(span / min(50, len(centres) + 1), within.whole), span)


def density(at: np.ndarray, centres: np.ndarray, widths: np.ndarray, within: Range) -> np.ndarray:
    normal = np.exp(-0.5 * ((at[:, None] - centres) / widths) ** 2) / (widths * np.sqrt(2 * np.pi))
    return (normal.sum(axis=1) + 1 / (within.high - within.low)) / (len(centres) + 1)


def search(space: dict[str, Range], evaluate: Callable[[list[dict[str, float]]], list[Trial]], rounds: int, batch: int, seed: int) -> list[Trial]:
    """All trials, in the order in which they were drawn; ``evaluate`` judges those of a round at once."""
    sampler, trials = Parzen(space, seed), []
    for _ in range(rounds):
        trials += evaluate(sampler.draw(trials, batch))
    return trials


def best(trials: Sequence[Trial]) -> Trial:
    return max(trials, key=lambda t: t.score)


def nested_search(
    outer: dict[str, Range],
    inner: dict[str, Range],
    prepare: Callable[[dict[str, float]], DataFrame],
    profit: Callable[[dict[str, float]], Column],
    rounds: tuple[int, int] = (2, 3),
    batch: tuple[int, int] = (2, 8),
    seed: int = 7,
) -> list[Trial]:
    """Outer trials, each with the inner trials made on the table that ``prepare`` gives for it, and scored by their best."""

    def judge(drawn: list[dict[str, float]]) -> list[Trial]:
        out = []
        for params in drawn:
            table = prepare(params)
            trials = search(inner, lambda many: judged(table, many, profit), rounds[1], batch[1], seed)
            out.append(Trial(params, best(trials).score, trials))
        return out

    return search(outer, judge, rounds[0], batch[0], seed)


def judged(table: DataFrame, drawn: list[dict[str, float]], profit: Callable[[dict[str, float]], Column], least: int = 20) -> list[Trial]:
    """Trials scored by the mean of their profits over its standard error, all in one pass; ``profit`` is null where a trial does not trade."""
    sums = []
    for i, params in enumerate(drawn):
        worth = profit(params)
        sums += [F.count(worth).alias(f"n{i}"), F.avg(worth).alias(f"m{i}"), F.stddev_samp(worth).alias(f"d{i}")]
    row = table.agg(*sums).first()
    out = []
    for i, params in enumerate(drawn):
        n, mean, deviation = row[f"n{i}"], row[f"m{i}"], row[f"d{i}"]
        out.append(Trial(params, round(float(mean / deviation * np.sqrt(n)), 9) if n >= least and deviation else REJECTED))
    return out
