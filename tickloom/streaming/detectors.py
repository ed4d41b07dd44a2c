"""Price patterns of a stream of closed bars, each series (instrument, timeframe) with a bounded state of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from tickloom.streaming.ordered import InOrder

EVENTS = "instrument string, timeframe string, detector string, time timestamp, confirmed timestamp, kind string, upper double, lower double"
RECENT = "at long, open double, high double, low double, close double, range double"
SWINGS = "seen long, high double, low double, high_open boolean, low_open boolean, trend string"
AT, OPEN, HIGH, LOW, CLOSE, RANGE = range(6)


class Series:
    """The last bars of a series, its two armed swings and the direction of its last break; ``add`` gives a bar's events."""

    def __init__(self, state: tuple | None, side: int, mean_of: int, displaced: float, block: float):
        self.side, self.mean_of, self.displaced, self.block = side, mean_of, displaced, block
        empty = ([], 0, 0.0, 0.0, False, False, "")
        recent, self.seen, self.high, self.low, self.high_open, self.low_open, self.trend = empty if state is None else state
        self.recent = [tuple(r) for r in recent]

    def state(self) -> tuple:
        return self.recent, self.seen, self.high, self.low, self.high_open, self.low_open, self.trend

    def add(self, at: int, o: float, h: float, low: float, c: float) -> list[tuple]:
        """Events as (detector, time, kind, upper, lower), those of the swing that this bar confirms first."""
        span = h - low
        if self.recent:
            before = self.recent[-1][CLOSE]
            span = max(span, abs(h - before), abs(low - before))
        held = max(self.mean_of, 2 * self.side + 1)
        self.recent = [*self.recent, (at, o, h, low, c, span)][-held:]
        self.seen += 1
        return [*self._swings(), *self._breaks(at, h, low), *self._gap(h, low), *self._bodies(at, o, c)]

    def _swings(self) -> list[tuple]:
        if self.seen <= 2 * self.side:
            return []
        around = self.recent[-2 * self.side - 1 :]
        middle, out = around[self.side], []
        if middle[HIGH] >= max(r[HIGH] for r in around):
            self.high, self.high_open = middle[HIGH], True
            out.append(("swing", middle[AT], "high", self.high, self.high))
        if middle[LOW] <= min(r[LOW] for r in around):
            self.low, self.low_open = middle[LOW], True
            out.append(("swing", middle[AT], "low", self.low, self.low))
        return out

    def _breaks(self, at: int, h: float, low: float) -> list[tuple]:
        out = []
        if self.high_open and h > self.high:
            self.high_open = False
            out.append(self._broken(at, "bullish", self.high))
        if self.low_open and low < self.low:
            self.low_open = False
            out.append(self._broken(at, "bearish", self.low))
        return out

    def _broken(self, at: int, direction: str, level: float) -> tuple:
        sort = "BOS" if self.trend in ("", direction) else "CHOCH"
        self.trend = direction
        return "break", at, f"{direction} {sort}", level, level

    def _gap(self, h: float, low: float) -> list[tuple]:
        if self.seen < 3:
            return []
        first, middle = self.recent[-3], self.recent[-2]
        if low > first[HIGH]:
            return [("gap", middle[AT], "bullish", low, first[HIGH])]
        return [("gap", middle[AT], "bearish", first[LOW], h)] if h < first[LOW] else []

    def _bodies(self, at: int, o: float, c: float) -> list[tuple]:
        if self.seen <= self.mean_of or c == o:
            return []
        mean = sum(r[RANGE] for r in self.recent[-self.mean_of :]) / self.mean_of
        body, before, kind = c - o, self.recent[-2], "bullish" if c > o else "bearish"
        out = [("displacement", at, kind, abs(body), mean)] if abs(body) >= mean * self.displaced else []
        if abs(body) > mean * self.block and body * (before[CLOSE] - before[OPEN]) < 0:
            out.append(("block", before[AT], kind, before[HIGH], before[LOW]))
        return out


class Detector(InOrder):
    """State beside the waiting bars: a list of the last bars of the series, and its swings and trend."""

    columns = ("time", "open", "high", "low", "close")

    def __init__(self, *rules: float):
        self.rules = rules

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.recent, self.swings = handle.getListState("recent", RECENT), handle.getValueState("swings", SWINGS)

    def released(self, key: tuple, rows: np.ndarray) -> pd.DataFrame:
        series = Series((list(self.recent.get()), *self.swings.get()) if self.swings.exists() else None, *self.rules)
        out = []
        for at, *prices in rows.tolist():
            out += [(*key, name, time, at, *rest) for name, time, *rest in series.add(at, *prices)]
        recent, *swings = series.state()
        self.recent.put(recent)
        self.swings.update(tuple(swings))
        found = pd.DataFrame(out, columns=["instrument", "timeframe", "detector", "time", "confirmed", "kind", "upper", "lower"])
        for column in ("time", "confirmed"):
            found[column] = pd.to_datetime(found[column], unit="us")
        return found


def detected(bars: DataFrame, lateness: str, *, side: int = 2, mean_of: int = 14, displaced: float = 1.5, block: float = 2.0) -> DataFrame:
    """Swings, breaks, gaps, displacements and order blocks of a stream of closed bars (instrument, timeframe, time and prices).

    ``time`` of an event is the bar that it belongs to, ``confirmed`` the bar at which it is known. A swing has
    ``side`` bars to each side; mean ranges are those of ``mean_of`` bars. Bars may come out of order by ``lateness``.
    """
    timed = bars.withWatermark("time", lateness).select("instrument", "timeframe", *Detector.columns)
    return timed.groupBy("instrument", "timeframe").transformWithStateInPandas(Detector(side, mean_of, displaced, block), EVENTS, "append", "EventTime")
