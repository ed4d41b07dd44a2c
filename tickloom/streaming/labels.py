"""Barrier labels of a stream of quotes."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from tickloom.operators.labels import _first
from tickloom.streaming.ordered import InOrder

LABELS = "instrument string, seq long, buy_label int, sell_label int"
OPEN = -9


class Barriers:
    """Open quotes, each side of them sorted by the price at which it is decided: the rules tick by tick, which tests hold ``settled`` against.

    Of a side, the quote that a price decides first is at the top of its heap, so a tick looks at those that it decides
    and one more. Quotes are decided by time in the order in which they came. On the tick past the timeout the barriers
    are tested first, the stop before the target.
    """

    def __init__(self, stop: float, target: float, span: int, pending: list[tuple] = ()):
        self.stop, self.target, self.span = stop, target, span
        self.quotes: dict[int, list] = {}
        self.by_time: deque[int] = deque()
        self.heaps: dict[str, list] = {"buy_stop": [], "buy_target": [], "sell_stop": [], "sell_target": []}
        self.number = 0
        for quote in pending:
            self._hold(list(quote))

    def _hold(self, quote: list) -> None:
        """``quote``: time, seq, bid, ask, buy and sell label."""
        self.number += 1
        self.quotes[self.number] = quote
        self.by_time.append(self.number)
        bid, ask = quote[2], quote[3]
        for name, level, side in (("buy_stop", -ask, 4), ("buy_target", ask, 4), ("sell_stop", bid, 5), ("sell_target", -bid, 5)):
            if quote[side] == OPEN:
                heapq.heappush(self.heaps[name], (level, self.number))

    def _decide(self, name: str, side: int, label: int, reached) -> None:
        heap = self.heaps[name]
        while heap and reached(heap[0][0]):
            quote = self.quotes.get(heapq.heappop(heap)[1])
            if quote is not None and quote[side] == OPEN:
                quote[side] = label
                self.decided.append(quote)

    def add(self, now: int, seq: int, bid: float, ask: float) -> list[list]:
        """The quotes of which this tick decides the last open side."""
        self.decided: list[list] = []
        self._decide("buy_stop", 4, 0, lambda level: bid <= -level - self.stop)
        self._decide("sell_stop", 5, 0, lambda level: ask >= level + self.stop)
        self._decide("buy_target", 4, 1, lambda level: bid >= level + self.target)
        self._decide("sell_target", 5, 1, lambda level: ask <= -level - self.target)
        while self.by_time and now - self.quotes[self.by_time[0]][0] > self.span:
            quote = self.quotes.pop(self.by_time.popleft())
            if OPEN in quote[4:]:
                quote[4] = _drift(bid - quote[3]) if quote[4] == OPEN else quote[4]
                quote[5] = _drift(quote[2] - ask) if quote[5] == OPEN else quote[5]
                self.decided.append(quote)
        self._hold([now, seq, bid, ask, OPEN, OPEN])
        done = {id(q): q for q in self.decided if OPEN not in q[4:]}
        return list(done.values())

    def pending(self) -> list[tuple]:
        """The quotes with an open side, in order of time."""
        return [tuple(self.quotes[n]) for n in self.by_time if OPEN in self.quotes[n][4:]]


def _drift(points: float) -> int:
    points = round(points, 9)
    return 1 if points > 0 else 0 if points < 0 else -1


#: Ticks that are looked through at once, at least.
BLOCK = 1 << 16
QUOTES = np.dtype([("time", "<i8"), ("seq", "<i8"), ("bid", "<f8"), ("ask", "<f8"), ("buy", "<i4"), ("sell", "<i4")])


def settled(pending: np.ndarray, ticks: np.ndarray, stop: float, target: float, span: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``Barriers`` decides in further ``ticks``, sorted: the quotes decided on both sides, and those still pending.

    First touches of all quotes of a block are found at once, by minima over doubling spans.
    """
    done, at = [], 0
    while at < len(ticks):
        some = ticks[at : at + max(BLOCK, len(pending))]
        at += len(some)
        new = np.empty(len(some), dtype=QUOTES)
        for c in ("time", "seq", "bid", "ask"):
            new[c] = some[c]
        new["buy"] = new["sell"] = OPEN
        quotes = np.concatenate([pending, new])
        start = np.concatenate([np.zeros(len(pending), dtype=np.int64), np.arange(1, len(some) + 1)])
        after = np.searchsorted(some["time"], quotes["time"] + span, side="right")
        end, over = np.minimum(after + 1, len(some)), after < len(some)
        last = np.minimum(after, len(some) - 1)
        bid, ask = some["bid"], some["ask"]
        low, high = ({n: np.where(np.isnan(v), np.inf, sign * v) for n, v in (("bid", bid), ("ask", ask))} for sign in (1, -1))
        sides = (
            ("buy", low["bid"], quotes["ask"] - stop, high["bid"], -(quotes["ask"] + target), bid[last] - quotes["ask"]),
            ("sell", high["ask"], -(quotes["bid"] + stop), low["ask"], quotes["bid"] - target, quotes["bid"] - ask[last]),
        )
        for side, stops, stop_at, targets, target_at, worth in sides:
            lost, won = _first(stops, stop_at, start, end), _first(targets, target_at, start, end)
            points = np.round(worth, 9)
            drift = np.where(points > 0, 1, np.where(points < 0, 0, -1))
            label = np.where((lost < end) & (lost <= won), 0, np.where(won < end, 1, np.where(over, drift, OPEN)))
            quotes[side] = np.where(quotes[side] == OPEN, label, quotes[side])
        decided = (quotes["buy"] != OPEN) & (quotes["sell"] != OPEN)
        done.append(quotes[decided])
        pending = quotes[~decided]
    return np.concatenate(done) if done else np.empty(0, dtype=QUOTES), pending


class Labeler(InOrder):
    """State beside the waiting rows: the quotes that are not decided, packed, at most those of one timeout."""

    columns = ("time", "seq", "bid", "ask")

    def __init__(self, stop: float, target: float, timeout_s: int):
        self.rules = stop, target, timeout_s * 1_000_000

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "quotes binary")

    def released(self, key: tuple, rows: np.ndarray) -> pd.DataFrame:
        pending = np.frombuffer(self.open.get()[0] if self.open.exists() else b"", dtype=QUOTES)
        done, pending = settled(pending, rows, *self.rules)
        if len(pending):
            self.open.update((pending.tobytes(),))
        else:
            self.open.clear()
        return pd.DataFrame({"instrument": key[0], "seq": done["seq"], "buy_label": done["buy"], "sell_label": done["sell"]})


def stream_labels(stream: DataFrame, stop: float, target: float, timeout_s: int, lateness: str) -> DataFrame:
    """Labels (1 win, 0 loss, -1 neither) of both sides of every quote (instrument, time, seq, bid, ask) once both are decided."""
    timed = stream.withWatermark("time", lateness).select("instrument", "time", "seq", "bid", "ask")
    return timed.groupBy("instrument").transformWithStateInPandas(Labeler(stop, target, timeout_s), LABELS, "append", "EventTime")
