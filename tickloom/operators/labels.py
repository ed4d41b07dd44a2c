"""Forward-scan labels: which of two barriers a row's price meets first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import range_join
from tickloom.sources.scratch import stored

MICROS = 1_000_000
#: Microseconds of a block, where four timeouts are shorter.
LEAST_BLOCK = 3600 * MICROS


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_micros(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("t", F.unix_micros(F.col("time").cast("timestamp")))


#: Columns that ``_first_hits`` adds: first row at each barrier within the timeout, and the first row beyond it.
HITS = "bs long, bt long, ss long, st long, o long, o_bid double, o_ask double"


def _first(values: np.ndarray, bound: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each query the first place in start <= place < end with values[place] <= bound; ``end`` where there is none.

    Minima over 1, 2, 4, ... values are compared from the longest to the shortest, all queries at once.
    """
    spans, longest = [values], int((end - start).max(initial=0))
    while 2 << (len(spans) - 1) <= longest:
        half = 1 << (len(spans) - 1)
        spans.append(np.minimum(spans[-1][:-half], spans[-1][half:]))
    at = start.copy()
    for k in range(len(spans) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= end)
        passed = fits[~(spans[k][at[fits]] <= bound[fits])]
        at[passed] += 1 << k
    return at


def _first_hits(span: int, block: int):
    """Rows of one block of time of a series, with those of one timeout more: its own rows with ``HITS``."""

    def plain(table: pa.Table, name: str, none: float) -> np.ndarray:
        """Values with NaN above all others, as Spark sorts it, and ``none`` for null."""
        known = table.column(name).is_null().to_numpy(zero_copy_only=False)
        values = table.column(name).fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
        return np.where(known, none, np.where(np.isnan(values), np.inf, values))

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("idx")
        t, idx = table.column("t").to_numpy(), table.column("idx").to_numpy()
        mine = np.flatnonzero(t // block == table.column("block")[0].as_py())
        after = np.searchsorted(t, t[mine] + span, side="right")
        bound = {n: plain(table.select([n]), n, np.nan)[mine] for n in ("buy_stop", "buy_target", "sell_stop", "sell_target")}
        low, high = {}, {}
        for side in ("bid", "ask"):
            low[side], high[side] = plain(table, side, np.inf), -plain(table, side, -np.inf)
        found = {
            "bs": _first(low["bid"], bound["buy_stop"], mine + 1, after),
            "bt": _first(high["bid"], -bound["buy_target"], mine + 1, after),
            "ss": _first(high["ask"], -bound["sell_stop"], mine + 1, after),
            "st": _first(low["ask"], bound["sell_target"], mine + 1, after),
        }
        out = table.take(pa.array(mine))
        for name, at in found.items():
            out = out.append_column(name, pa.array(idx[np.minimum(at, len(idx) - 1)], mask=at >= after))
        beyond = pa.array(after, mask=after >= len(t))
        for name, column in (("o", "idx"), ("o_bid", "bid"), ("o_ask", "ask")):
            out = out.append_column(name, table.column(column).take(beyond))
        return out

    return find


def barrier_labels(rows: DataFrame, stop: Column, target: Column, timeout_s: int) -> DataFrame:
    """buy and sell label (1 win, 0 loss, -1 none), profit and exit row of every row.

    A buy enters at the ask and leaves at bids, a sell the other way round. Stop comes before target; at the
    first row past the timeout the position closes at the market, with the sign of its profit as label. ``rows``
    has instrument, idx (in order of time), time, bid, ask; ``stop`` and ``target`` are distances. A series is cut into
    blocks of four timeouts, each with copies of the rows of one timeout more, so each row is moved once or twice and a task
    holds one block of one series. Within it the first touch of each barrier is found by minima over doubling spans, so the
    work grows with the logarithm of the number of rows within the timeout. Rows without a time touch nothing.
    """
    span = timeout_s * MICROS
    block = max(4 * span, LEAST_BLOCK)
    timed = with_micros(rows).withColumns({"stop": stop, "target": target}).select("instrument", "idx", "t", "bid", "ask", "stop", "target")
    timed = timed.withColumns({c: F.col(c).cast("double") for c in ("bid", "ask", "stop", "target")})
    timed = timed.withColumns({"idx": F.col("idx").cast("long"), "block": F.floor(F.col("t") / block), "before": F.floor((F.col("t") - span) / block)})
    timed = stored(timed, "labelled-rows")
    limits = {"buy_stop": F.col("ask") - F.col("stop"), "buy_target": F.col("ask") + F.col("target"), "sell_stop": F.col("bid") + F.col("stop"), "sell_target": F.col("bid") - F.col("target")}
    known = timed.where(F.col("t").isNotNull())
    spread = known.withColumns(limits).withColumn("block", F.explode(F.array_distinct(F.array("block", "before")))).drop("before")
    met = spread.groupBy("instrument", "block").applyInArrow(_first_hits(span, block), f"{_ddl(spread)}, {HITS}").drop(*limits)
    # Beyond the rows of a block and one timeout: the first row of those that come later, from one row a block.
    ends = known.groupBy("instrument", F.col("before").alias("block")).agg(F.min(F.struct("idx", "bid", "ask")).alias("end"))
    places = ends.unionByName(known.select("instrument", "block", F.lit(None).cast(ends.schema["end"].dataType).alias("end")).distinct())
    places = places.groupBy("instrument", "block").agg(F.first("end", ignorenulls=True).alias("end"))
    later = Window.partitionBy("instrument").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select("instrument", "block", F.last("end", ignorenulls=True).over(later).alias("carry"))
    carried = carried.where(F.col("carry").isNotNull()).withColumnRenamed("instrument", "of").withColumnRenamed("block", "at")
    joined = met.join(F.broadcast(carried), F.col("of").eqNullSafe(F.col("instrument")) & (F.col("at") == F.col("block")), "left")
    gone = F.col("o").isNull()
    joined = joined.withColumns({n: F.when(gone, F.col("carry")[c]).otherwise(F.col(n)) for n, c in (("o_bid", "bid"), ("o_ask", "ask"), ("o", "idx"))})
    untimed = timed.where(F.col("t").isNull()).drop("before")
    joined = joined.drop("of", "at", "carry").unionByName(untimed, allowMissingColumns=True)

    def side(s: str, g: str, at_market: Column) -> tuple[Column, Column, Column]:
        lost = F.col(s).isNotNull() & (F.col(g).isNull() | (F.col(s) <= F.col(g)))
        won, timed_out = F.col(g).isNotNull(), F.col("o").isNotNull()
        drift = F.round(at_market, 9)
        label = F.when(lost, 0).when(won, 1).when(timed_out & (drift > 0), 1).when(timed_out & (drift < 0), 0).otherwise(-1)
        pnl = F.when(lost, -F.col("stop")).when(won, F.col("target")).when(timed_out, at_market).otherwise(0.0)
        leave = F.when(lost, F.col(s)).when(won, F.col(g)).otherwise(F.col("o"))
        return label, pnl, leave

    buy, sell = side("bs", "bt", F.col("o_bid") - F.col("ask")), side("ss", "st", F.col("bid") - F.col("o_ask"))
    names = ("label", "pnl", "exit")
    out = {f"{k}_{n}": c for k, cs in (("buy", buy), ("sell", sell)) for n, c in zip(names, cs)}
    return joined.withColumns(out).select("instrument", "idx", "bid", "ask", "t", "stop", "target", *out)


def exit_paths(labelled: DataFrame, rows: DataFrame, target: Column, width: int = 512) -> DataFrame:
    """Every row of each resolved trade's path with what it is worth there, and whether that beats the final profit.

    ``target``: 1 buy, 2 sell, 0 none. A path runs to its exit row, however many rows that takes: it is looked up in
    each block of ``width`` rows that it crosses, so rows meet within one block.
    """
    side = labelled.withColumn("direction", target).where("direction > 0")
    buy = F.col("direction") == 1
    entries = side.select(
        "instrument",
        "idx",
        F.col("t").alias("t0"),
        "direction",
        F.when(buy, F.col("ask")).otherwise(F.col("bid")).alias("entry"),
        F.when(buy, F.col("buy_exit")).otherwise(F.col("sell_exit")).alias("leave"),
        F.when(buy, F.col("buy_pnl")).otherwise(F.col("sell_pnl")).alias("final"),
    ).where(F.col("leave").isNotNull())
    path = with_micros(rows).select("instrument", F.col("idx").alias("row_index"), F.col("t").alias("tj"), F.col("bid").alias("bid_j"), F.col("ask").alias("ask_j"))

    def block(at: Column) -> Column:
        return F.floor(at / width).cast("long")

    crossed = entries.withColumn("block", F.explode(F.sequence(block(F.col("idx") + 1), block(F.col("leave")))))
    placed = path.withColumn("block", block(F.col("row_index")))
    met = crossed.join(placed, ["instrument", "block"]).where("row_index > idx and row_index <= leave")
    unrealized = F.when(F.col("direction") == 1, F.col("bid_j") - F.col("entry")).otherwise(F.col("entry") - F.col("ask_j"))
    return met.withColumn("unrealized", unrealized).select(
        "instrument",
        F.col("idx").alias("entry_index"),
        "row_index",
        F.when(F.col("direction") == 1, 1.0).otherwise(-1.0).alias("direction"),
        "unrealized",
        ((F.col("tj") - F.col("t0")) / MICROS).alias("duration"),
        (F.round("unrealized", 9) > F.round("final", 9)).cast("int").alias("label"),
    )


def bar_labels(bars: DataFrame, horizon: int, stop: float, target: float) -> DataFrame:
    """Entry at the next bar's open, then ``horizon`` bars of highs and lows: 1 target first, 0 otherwise, null at the tail."""
    from tickloom.operators.series import bounded

    entered = bounded(bars, lambda w: {"entry": F.lead("open").over(w), "tail": F.lead("open", horizon).over(w)}, ahead=horizon)
    own = entered.select("instrument", "idx", "time", "entry", "tail")
    path = bars.select("instrument", F.col("idx").alias("j"), F.col("high").alias("high_j"), F.col("low").alias("low_j"))
    met = range_join(own, path, ["instrument"], "j", F.col("idx") + 1, F.col("idx") + horizon, horizon)
    hits = met.groupBy("instrument", "idx").agg(
        F.min(F.when(F.col("low_j") <= F.col("entry") - stop, F.col("j"))).alias("s"),
        F.min(F.when(F.col("high_j") >= F.col("entry") + target, F.col("j"))).alias("g"),
    )
    won = F.col("g").isNotNull() & (F.col("s").isNull() | (F.col("g") < F.col("s")))
    out = own.join(hits, ["instrument", "idx"], "left")
    return out.select("instrument", "idx", "time", "entry", F.when(F.col("tail").isNotNull(), won.cast("int")).alias("label"))
