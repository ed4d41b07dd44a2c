"""Table functions that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

SEQUENCES = "instrument string, segment long, start_idx long, features array<double>"
KEYS = ("instrument", "segment", "idx")


class _Sequences:
    """Whole windows of ``length`` rows, one every ``stride`` rows of a segment, their features row after row.

    ``rows`` has instrument, segment, idx and features, partitioned by the first two and ordered by the third. Batches are
    taken as they come: between them only the last rows that a later window needs are kept. Segments shorter than a
    window give none; a null feature is a NaN.
    """

    def __init__(self):
        self.kept, self.first, self.seen = None, None, 0

    def eval(self, rows: pa.RecordBatch, length: pa.Array, stride: pa.Array) -> Iterator[pa.Table]:
        size, step = length[0].as_py(), stride[0].as_py()
        if size <= 0 or step <= 0:
            raise ValueError("length and stride must be positive")
        names = [n for n in rows.schema.names if n not in KEYS]
        fresh = np.stack([rows.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], axis=1)
        if self.first is None:
            self.first = rows.column("idx")[0].as_py()
        values = fresh if self.kept is None else np.concatenate([self.kept, fresh])
        begin = self.seen  # place in the segment of the first row of ``values``
        starts = np.arange(begin + -begin % step, begin + len(values) - size + 1, step)
        if len(starts):
            windows = np.lib.stride_tricks.sliding_window_view(values, size, axis=0)[starts - begin].transpose(0, 2, 1)
            n = len(starts)
            flat = pa.ListArray.from_arrays(np.arange(0, (n + 1) * size * len(names), size * len(names), dtype=np.int32), windows.ravel())
            same = [pa.array([rows.column(k)[0].as_py()] * n, t) for k, t in (("instrument", pa.string()), ("segment", pa.int64()))]
            yield pa.table([*same, pa.array(self.first + starts), flat], names=["instrument", "segment", "start_idx", "features"])
        spare = max(0, len(values) - size + 1)
        self.kept, self.seen = values[spare:].copy(), begin + spare


def register(spark: SparkSession) -> None:
    """``sequences(rows => TABLE(t) PARTITION BY (instrument, segment) ORDER BY (idx), length => n, stride => k)`` for SQL."""
    spark.udtf.register("sequences", arrow_udtf(_Sequences, returnType=SEQUENCES))
