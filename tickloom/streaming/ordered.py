"""Stateful processors that see the rows of a key in order of time, in whatever order files and batches bring them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them and hands them on by ``columns``, the first of which is a time.

    Rows wait in a map by span of time, packed; an event-time timer stands at the first of them. When the watermark passes
    it, ``released`` gets the rows older than the watermark, sorted; none of them can come later, as late rows are
    dropped. So what is released, and in which order, does not depend on how rows were dealt over files and batches.
    State: the rows of the feed's disorder, and what a subclass keeps in ``opened``.
    """

    columns: tuple[str, ...] = ()
    #: Columns that hold whole numbers.
    whole: tuple[str, ...] = ("seq",)
    span_us = 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")
        self.alarm = handle.getValueState("alarm", "at long")
        self.kind = np.dtype([(c, "<i8" if n == 0 or c in self.whole else "<f8") for n, c in enumerate(self.columns)])
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Name further state."""

    def released(self, key: tuple, rows: np.ndarray) -> pd.DataFrame:
        """What comes of complete rows, sorted by their columns."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, spans = None, {}
        for frame in rows:
            packed = np.empty(len(frame), dtype=self.kind)
            for n, c in enumerate(self.columns):
                packed[c] = frame[c].to_numpy("datetime64[us]").astype("<i8") if n == 0 else frame[c].to_numpy()
            at = packed[self.columns[0]]
            first = int(at.min()) if first is None else min(first, int(at.min()))
            for span in np.unique(at // self.span_us):
                spans.setdefault(int(span), []).append(packed[at // self.span_us == span])
        for span, parts in spans.items():
            before = self.waiting.getValue((span,)) if self.waiting.containsKey((span,)) else None
            self.waiting.updateValue((span,), ((before[0] if before else b"") + np.concatenate(parts).tobytes(),))
        if first is not None:
            self._wake(first // 1000 + 1)
        yield pd.DataFrame()

    def _wake(self, at: int) -> None:
        """Keep one timer, at the first waiting row."""
        if self.alarm.exists():
            known = self.alarm.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        reached, done, left = timerValues.getCurrentWatermarkInMs() * 1000, [], None
        for span in sorted(k[0] for k in self.waiting.keys()):
            if span * self.span_us >= reached:
                left = self._first(span) if left is None else left
                break
            rows = np.frombuffer(self.waiting.getValue((span,))[0], dtype=self.kind)
            complete = rows[self.columns[0]] < reached
            done.append(rows[complete])
            if complete.all():
                self.waiting.removeKey((span,))
            else:
                self.waiting.updateValue((span,), (rows[~complete].tobytes(),))
                left = int(rows[~complete][self.columns[0]].min())
        if left is not None:
            self._wake(left // 1000 + 1)
        ready = np.concatenate(done) if done else np.empty(0, dtype=self.kind)
        if len(ready):
            yield self.released(key, np.sort(ready, order=list(self.columns)))

    def _first(self, span: int) -> int:
        return int(np.frombuffer(self.waiting.getValue((span,))[0], dtype=self.kind)[self.columns[0]].min())

    def close(self) -> None:
        pass
