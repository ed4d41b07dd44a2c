"""Feature sets that declare tunable parameters, composed under one flat space of names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.levels import level_features
from tickloom.operators.quotes import Quotes, View, level_view, quote_view, scalp_view
from tickloom.operators.rolling import scalping, spread_z
from tickloom.operators.series import bounded

ROW = ("instrument", "time")


@dataclass(frozen=True)
class Tunable:
    name: str
    default: float
    low: float
    high: float
    kind: str = "float"


@dataclass(frozen=True)
class FeatureSet:
    """``build`` gets bars with idx and this set's own parameters, and gives instrument, time and the features of each bar.

    ``view`` gets quotes and the parameters, and gives the state of the bars after each number of closed base bars and the
    features of a quote as columns over it; the state is then a struct with the name of the set.
    """

    name: str
    tunables: tuple[Tunable, ...]
    build: Callable[[DataFrame, dict[str, float]], DataFrame]
    view: Callable[[Quotes, dict[str, float]], View] | None = None


class Registry:
    """Feature sets side by side; parameters and features are named ``set__name``."""

    def __init__(self, sets: Sequence[FeatureSet]):
        if len({s.name for s in sets}) < len(sets):
            raise ValueError("two feature sets have one name")
        self.sets = tuple(sets)

    def tunables(self) -> list[Tunable]:
        return [replace(t, name=f"{s.name}__{t.name}") for s in self.sets for t in s.tunables]

    def tunables_column(self) -> Column:
        """The tunable parameters as an array of structs."""
        numbers = ("default", "low", "high")
        return F.array(*[F.struct(F.lit(t.name).alias("name"), *[F.lit(float(getattr(t, n))).alias(n) for n in numbers], F.lit(t.kind).alias("kind")) for t in self.tunables()])

    def settings(self, params: dict[str, float]) -> dict[str, dict[str, float]]:
        """Each set's parameters under their own names; those not given have their default, unknown ones are ignored."""
        found = {s.name: {t.name: params.get(f"{s.name}__{t.name}", t.default) for t in s.tunables} for s in self.sets}
        return {s.name: {t.name: int(found[s.name][t.name]) if t.kind == "int" else found[s.name][t.name] for t in s.tunables} for s in self.sets}

    def features(self, bars: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
        """All features of each bar: one row for each instrument and time."""
        own, parts = self.settings(params or {}), [bars.select(*ROW)]
        for s in self.sets:
            built = s.build(bars, own[s.name])
            parts.append(built.select(*ROW, *[F.col(c).alias(f"{s.name}__{c}") for c in built.columns if c not in ROW]))
        return reduce(lambda a, b: a.join(b, list(ROW), "left"), parts)

    def quote_features(self, quotes: Quotes, params: dict[str, float] | None = None) -> DataFrame:
        """All features of each quote: the states of all sets meet by bar, and quotes meet them in one join."""
        own, state, out, key = self.settings(params or {}), None, {}, ["instrument", "closed"]
        for s in self.sets:
            found, columns = s.view(quotes, own[s.name])
            packed = found.select(*key, F.struct(*[c for c in found.columns if c not in key]).alias(s.name))
            state = packed if state is None else state.join(packed, key)
            out |= {f"{s.name}__{n}": c for n, c in columns.items()}
        return quotes.rows.join(state, key).select("instrument", "seq", *[c.alias(n) for n, c in out.items()])


def _scalp(bars: DataFrame, own: dict[str, float]) -> DataFrame:
    names = ("roc_fast", "roc_slow", "mean_rev_z", "atr", "body_ratio")
    return scalping(bars, own["roc_fast"], own["roc_slow"], own["mean_rev_period"], own["atr_period"]).select(*ROW, *names)


def _tick(bars: DataFrame, own: dict[str, float]) -> DataFrame:
    n, span = own["spread_avg_period"], F.col("high") - F.col("low")
    position = F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5)
    seen = bounded(bars, lambda w: {"spread_z": spread_z(w, n)}, back=n - 1)
    return seen.select(*ROW, "spread", "spread_z", span.alias("bar_range"), position.alias("position"))


def _ict(tolerance: float) -> Callable[[DataFrame, dict[str, float]], DataFrame]:
    def build(bars: DataFrame, own: dict[str, float]) -> DataFrame:
        views = bars.select(*ROW, F.col("close").alias("price"), F.col("idx").alias("at_idx"))
        return level_features(views, bars, own["level_max_age"], own["lookback"], tolerance)

    return build


def standard(tolerance: float = 0.1, scalp_widths: tuple[int, ...] = (1, 6), level_widths: tuple[int, ...] = (30, 360)) -> Registry:
    """Levels and structure, rates of change, and quotes, with seven tunable parameters; widths are in base bars, for quotes."""
    return Registry(
        [
            # The names, defaults and ranges of the tunables.
            FeatureSet("ict", (Tunable("lookback", 20, 5, 50, "int"), Tunable("level_max_age", 100, 20, 300, "int")), _ict(tolerance), level_view(level_widths, tolerance)),
            FeatureSet(
                "scalp",
                (
                    Tunable("roc_fast", 5, 2, 15, "int"),
                    Tunable("roc_slow", 20, 10, 60, "int"),
                    Tunable("mean_rev_period", 30, 10, 100, "int"),
                    Tunable("atr_period", 14, 5, 50, "int"),
                ),
                _scalp,
                scalp_view(scalp_widths),
            ),
            FeatureSet("tick", (Tunable("spread_avg_period", 30, 10, 100, "int"),), _tick, quote_view),
        ]
    )
