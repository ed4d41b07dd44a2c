"""Position simulations: folds in time order with capital feedback.

What a bar or tick offers is computed as columns; only the fold itself is Python. Rows of a run are
sorted within their partition and streamed through it, so a task holds one batch and the open
positions, however long the series. Runs (parameters, windows, instruments) spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADE_SCHEMA = (
    "instrument string, run string, direction string, entry_idx long, exit_idx long, entry_price double, exit_price double, stop double, target double, "
    "size double, pnl double, r_multiple double, reason string, capital double"
)


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[tuple], Any], schema: str) -> DataFrame:
    """Run a fold over each group in order. ``start(key)`` gives an object with step(row) and finish(), which return rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    if state is not None:
                        out += state.finish()
                    key, state = own, start(own)
                out += state.step(row)
            if out:
                yield pd.DataFrame(out)
                out = []
        if state is not None and (rest := state.finish()):
            yield pd.DataFrame(rest)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


@dataclass
class Open:
    direction: int
    idx: int
    entry: float
    stop: float
    target: float
    size: float
    margin: float = 0.0
    first_stop: float = 0.0
    moved: bool = False


@dataclass
class Account:
    """Capital, open positions and their closing, shared by the simulations."""

    key: tuple
    capital: float
    point: float = 1.0
    held: list[Open] = field(default_factory=list)
    last: Any = None

    def close(self, pos: Open, price: float, idx: int, reason: str) -> dict:
        points = (price - pos.entry) * pos.direction
        pnl = points * pos.size * self.point
        self.capital += pnl
        risk = abs(pos.entry - (pos.first_stop or pos.stop))
        return {
            "instrument": self.key[0],
            "run": self.key[1],
            "direction": "BUY" if pos.direction > 0 else "SELL",
            "entry_idx": pos.idx,
            "exit_idx": idx,
            "entry_price": pos.entry,
            "exit_price": price,
            "stop": pos.stop,
            "target": pos.target,
            "size": pos.size,
            "pnl": pnl,
            "r_multiple": points / risk if risk else 0.0,
            "reason": reason,
            "capital": self.capital,
        }

    @property
    def margin(self) -> float:
        return sum(p.margin for p in self.held)


def crossed(pos: Open, low: float, high: float) -> tuple[float, str] | None:
    """Stop before target, by the prices at which the position can be left."""
    if pos.direction > 0:
        return (pos.stop, "stop") if low <= pos.stop else (pos.target, "target") if high >= pos.target else None
    return (pos.stop, "stop") if high >= pos.stop else (pos.target, "target") if low <= pos.target else None


@dataclass(frozen=True)
class TickRules:
    stop: float = 40.0
    target: float = 60.0
    k_stop: float | None = None
    k_target: float | None = None
    capital: float = 5000.0
    size: float = 0.1
    most_open: int = 1
    widest_spread: float = 2.0
    gamma: float | None = None
    full_at: float = 0.85
    threshold: float = 1 / 3
    margin_share: float = 0.05
    lot: float = 0.1
    least_risk: float | None = None


def ramp_size(rules: TickRules, confidence: float, room: float, margin_per_lot: float) -> float | None:
    """Size on a power curve of the confidence above the threshold, up to all free margin; None below a lot."""
    if margin_per_lot <= 0 or rules.full_at <= rules.threshold:
        return None
    share = min(max((confidence - rules.threshold) / (rules.full_at - rules.threshold), 0.0), 1.0) ** rules.gamma
    size = math.floor(share * room / margin_per_lot / rules.lot + 1e-9) * rules.lot
    return size if size >= rules.lot - 1e-12 else None


class TickRun:
    """Quotes with signals: exits first, then at most one entry, everything left over closed at the end."""

    def __init__(self, key: tuple, rules: TickRules):
        self.rules, self.account = rules, Account(key, rules.capital)

    def step(self, row) -> list[dict]:
        own, out, left = self.account, [], []
        for pos in own.held:
            price = row.bid if pos.direction > 0 else row.ask
            hit = crossed(pos, price, price)
            if hit:
                out.append(own.close(pos, hit[0], row.idx, hit[1]))
            else:
                left.append(pos)
        own.held, own.last = left, row
        if row.signal and len(own.held) < self.rules.most_open and row.ask - row.bid <= self.rules.widest_spread:
            pos = self._entry(row)
            if pos:
                own.held.append(pos)
        return out

    def _entry(self, row) -> Open | None:
        rules, side = self.rules, int(row.signal)
        price = row.ask if side > 0 else row.bid
        scaled = rules.k_stop is not None and rules.k_target is not None and row.atr > 0
        stop, target = (rules.k_stop * row.atr, rules.k_target * row.atr) if scaled else (rules.stop, rules.target)
        size, margin = rules.size, 0.0
        if rules.gamma is not None:
            per_lot, room = price * rules.margin_share, self.account.capital - self.account.margin
            size = ramp_size(rules, row.confidence, room, per_lot)
            if rules.least_risk is not None and stop > 0:
                floor = math.ceil(rules.least_risk * self.account.capital / (stop * self.account.point) / rules.lot - 1e-9) * rules.lot
                if size is None or size < floor:
                    size = floor if floor * per_lot <= room else None
            if size is None:
                return None
            margin = size * per_lot
        return Open(side, int(row.idx), price, price - side * stop, price + side * target, size, margin)

    def finish(self) -> list[dict]:
        own, row = self.account, self.account.last
        return [own.close(p, row.bid if p.direction > 0 else row.ask, int(row.idx), "end") for p in own.held] if own.held else []


@dataclass(frozen=True)
class BarRules:
    stop: float = 30.0
    target: float = 45.0
    capital: float = 5000.0
    widest_spread: float = 2.0
    margin_use: float = 0.5
    margin_share: float = 0.05
    lot: float = 0.1
    threshold: float = 0.5


class BarRun:
    """One position at a time, entered at the next bar's open; a negative threshold trades against the signal."""

    def __init__(self, key: tuple, rules: BarRules):
        self.rules, self.account = rules, Account(key, rules.capital)

    def step(self, row) -> list[dict]:
        own, rules, out = self.account, self.rules, []
        if pd.isna(row.next_open):
            return out
        if own.held:
            hit = crossed(own.held[0], row.low, row.high)
            if hit:
                out.append(own.close(own.held.pop(), hit[0], int(row.idx), hit[1]))
        if not own.held and row.signal and row.confidence >= abs(rules.threshold) and row.next_spread <= rules.widest_spread:
            size = math.floor(rules.margin_use * own.capital / (row.next_open * rules.margin_share) / rules.lot) * rules.lot
            if size >= rules.lot:
                side = int(row.signal) * (-1 if rules.threshold < 0 else 1)
                entry = row.next_open + side * row.next_spread / 2
                own.held.append(Open(side, int(row.idx), entry, entry - side * rules.stop, entry + side * rules.target, size))
        return out

    def finish(self) -> list[dict]:
        return []


@dataclass(frozen=True)
class CandleRules:
    capital: float = 10_000.0
    risk: float = 0.01
    leverage: float = 30.0
    step: float = 0.1
    least: float = 0.1
    most_open: int = 3
    widest_spread: float = 5.0
    least_score: float = 0.5
    even_at: float = 0.6
    even_offset: float = 0.05
    most_bars: int = 48
    day_loss: float = 0.03
    day_gain: float = 0.05
    total_loss: float = 0.2


class CandleRun:
    """Bars with scored signals: break-even move, time exit, stop before target, then circuit breakers, sizing and entry."""

    def __init__(self, key: tuple, rules: CandleRules):
        self.rules, self.account = rules, Account(key, rules.capital)
        self.day, self.day_pnl = None, 0.0

    def step(self, row) -> list[dict]:
        own, out, left = self.account, [], []
        if row.day != self.day:
            self.day, self.day_pnl = row.day, 0.0
        for pos in own.held:
            hit = self._leave(pos, row)
            if hit:
                out.append(own.close(pos, hit[0], int(row.idx), hit[1]))
                self.day_pnl += out[-1]["pnl"]
            else:
                left.append(pos)
        own.held, own.last = left, row
        if self._may_enter(row):
            pos = self._entry(row)
            if pos:
                own.held.append(pos)
        return out

    def _leave(self, pos: Open, row) -> tuple[float, str] | None:
        rules, short = self.rules, row.spread if pos.direction < 0 else 0.0
        low, high, close = row.low + short, row.high + short, row.close + short
        width = abs(pos.target - pos.entry)
        progress = (high - pos.entry) if pos.direction > 0 else (pos.entry - low)
        if not pos.moved and width > 0 and progress / width >= rules.even_at:
            better = pos.entry + pos.direction * width * rules.even_offset
            better = min(better, row.close) if pos.direction > 0 else max(better, close)
            if (better - pos.stop) * pos.direction > 0:
                pos.first_stop, pos.stop, pos.moved = pos.stop, better, True
        if row.idx - pos.idx >= rules.most_bars:
            return close, "time"
        return crossed(pos, low, high)

    def _may_enter(self, row) -> bool:
        own, rules = self.account, self.rules
        stopped = self.day_pnl <= -rules.day_loss * rules.capital or self.day_pnl >= rules.day_gain * rules.capital
        ruined = own.capital <= rules.capital * (1 - rules.total_loss)
        news = row.paused
        return not (stopped or ruined or news) and bool(row.signal) and row.score >= rules.least_score and row.spread <= rules.widest_spread and len(own.held) < rules.most_open

    def _entry(self, row) -> Open | None:
        own, rules, side = self.account, self.rules, int(row.signal)
        entry = row.close + (row.spread if side > 0 else 0.0)
        distance = row.stop_distance
        if not distance > 0 or entry <= 0:
            return None
        size = math.floor(own.capital * rules.risk / distance / rules.step + 1e-9) * rules.step
        size = min(size, math.floor((own.capital - own.margin) * rules.leverage / entry / rules.step) * rules.step)
        if size < rules.least:
            return None
        return Open(side, int(row.idx), entry, entry - side * distance, entry + side * 2 * distance, size, size * entry / rules.leverage)

    def finish(self) -> list[dict]:
        own = self.account
        return [own.close(p, own.last.close, int(own.last.idx), "end") for p in own.held] if own.held else []


def simulate(df: DataFrame, run: type, rules: dict[str, Any]) -> DataFrame:
    """Trades of every (instrument, run); ``rules`` maps the name of a run to its rules, and every run sees all rows."""
    names = F.explode(F.array(*[F.lit(n) for n in rules]))
    return fold(df.withColumn("run", names), ["instrument", "run"], ["idx"], lambda key: run(key, rules[key[1]]), TRADE_SCHEMA)


def rollout(paths: DataFrame, group: Sequence[str], cost: float, idle: float) -> DataFrame:
    """Compounded value of acting along each path of (step, action, ret): returns times the position held, costs on changes."""
    own = paths.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("step", "action", "ret"))).alias("_steps"))
    start = F.struct(F.lit(1.0).alias("value"), F.lit(0).alias("position"), F.lit(0.0).alias("reward"))

    def step(acc: Column, s: Column) -> Column:
        turned = F.abs(s["action"] - acc["position"])
        gain = s["action"] * s["ret"] - turned * cost - F.when(s["action"] == 0, idle).otherwise(0.0)
        return F.struct((acc["value"] * (1 + gain)).alias("value"), s["action"].cast("int").alias("position"), (acc["reward"] + gain).alias("reward"))

    return own.select(*group, F.aggregate("_steps", start, step).alias("_end")).select(*group, "_end.value", "_end.reward")
