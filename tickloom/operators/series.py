"""Row numbers, bounded windows and running values over series that are too long for one task.

A window over a whole instrument puts its history into one task. Here a series is numbered by blocks of
time, bounded frames run in chunks of rows with the neighbours' edge rows copied in, and running values
are local to a chunk and joined with what the chunks before carry over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("instrument",)
CHUNK_ROWS = 50_000
BLOCK = "7 days"


def with_index(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("time",), block: str = BLOCK) -> DataFrame:
    """``idx``: position of each row in its series, from 0; tasks hold a block of time, not a series."""
    blocked = df.withColumn("_block", F.window(order[0], block)["start"])
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(*keys, "_block").orderBy(*order)
    numbered = blocked.withColumn("_row", F.row_number().over(own)).join(offsets, [*keys, "_block"])
    return numbered.withColumn("idx", (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_block", "_row", "_offset")


def bounded(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]] | Sequence[Callable[[WindowSpec], dict[str, Column]]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add columns computed over a window that reaches ``back`` rows behind and ``ahead`` rows ahead of each row.

    ``columns`` gets the window (ordered by idx, without a frame). ``df`` has idx. Several functions run one after the
    other over one shuffle, each with the columns of those before; ``back`` and ``ahead`` are then the sum of their reaches.
    """
    if max(back, ahead) > rows:
        raise ValueError("a chunk must be as long as the frame")
    chunk, at = F.floor(F.col("idx") / rows), F.pmod(F.col("idx"), F.lit(rows))
    places = F.array_compact(F.array(chunk, F.when(at >= rows - back, chunk + 1), F.when(at < ahead, chunk - 1)))
    spread = df.withColumn("_chunk", F.explode(places)).withColumn("_own", F.col("_chunk") == chunk)
    window = Window.partitionBy(*keys, "_chunk").orderBy("idx")
    for step in [columns] if callable(columns) else columns:
        spread = spread.withColumns(step(window))
    return spread.where("_own").drop("_chunk", "_own")


def last_n(window: WindowSpec, n: int) -> WindowSpec:
    """The row and the n - 1 before it."""
    return window.rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, first: int = 0) -> Column:
    """A frame's value once n rows from row ``first`` on are in it; null before."""
    return F.when(F.col("idx") >= first + n - 1, value)


def running(df: DataFrame, values: dict[str, tuple[str, Column]], keys: Sequence[str] = KEYS, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add running values up to and with each row. ``values``: name -> (sum | max | min | last, column); last skips nulls."""
    local = Window.partitionBy(*keys, "_chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    chunked = df.withColumn("_chunk", F.floor(F.col("idx") / rows)).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    whole = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("idx"))) if k == "last" else over[k](F.col(f"_v_{n}")) for n, (k, _) in values.items()}
    sums = chunked.groupBy(*keys, "_chunk").agg(*[c.alias(f"_w_{n}") for n, c in whole.items()])
    carry = sums.select(*keys, "_chunk", *[over[k](F.col(f"_w_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in values.items()])
    merge = {
        "sum": lambda a, b: F.coalesce(a + b, a, b),
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "last": lambda a, b: F.coalesce(b, a),
    }
    joined = chunked.withColumns({f"_l_{n}": over[k](F.col(f"_v_{n}")).over(local) for n, (k, _) in values.items()}).join(carry, [*keys, "_chunk"])
    out = joined.withColumns({n: merge[k](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in values.items()})
    return out.drop("_chunk", *[f"_{p}_{n}" for p in "vlc" for n in values])
