"""Which of many possible trades are taken when one may be open at a time, without folding over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import running
from tickloom.sources.scratch import stored


def next_entries(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, idx and ``then``, the first entry at or after its exit (null where there is none), of each entry with an exit.

    Exit rows and entries of a series are merged in reverse order and the last entry seen is carried along, in chunks of rows.
    """
    closed = entries.where(F.col("exit_idx").isNotNull()).select(*keys, "idx", F.greatest(F.col("exit_idx"), F.col("idx") + 1).alias("exit_idx"))
    starts = entries.select(*keys, F.col("idx").alias("at"), F.lit(1).alias("side"))
    ends = closed.select(*keys, F.col("exit_idx").alias("at")).distinct().withColumn("side", F.lit(0))
    # Reversed, an entry comes before an exit at its own row: two slots a row.
    merged = starts.unionByName(ends).select(*keys, (-2 * F.col("at") - F.col("side")).alias("idx"), "at", "side")
    carried = running(merged, {"then": ("last", F.when(F.col("side") == 1, F.col("at")))}, keys)
    after = carried.where("side = 0").select(*keys, F.col("at").alias("exit_idx"), "then")
    return closed.join(after, [*keys, "exit_idx"]).select(*keys, "idx", "then")


def one_at_a_time(entries: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """The entries (keys, idx, exit_idx, and more) taken when a series has one trade open at most.

    The first entry of a series is taken, and after each the first that starts at or after its exit; a trade without an
    exit stays open, and nothing follows it; one ends after the row it starts at, whatever its exit says. Entries point to the one that would follow them. Pointers are doubled: in
    each round all taken entries mark those that lie a power of two further on, so rounds grow with the logarithm of the
    longest chain and no task walks along one. Each (keys, idx) must be unique; a null idx is never taken.
    """
    known = entries.where(F.col("idx").isNotNull())
    jumps = stored(next_entries(known, keys).where(F.col("then").isNotNull()), "jumps")
    taken = stored(known.groupBy(*keys).agg(F.min("idx").alias("idx")), "taken")
    # Nothing reaches an entry that no other points to, but the first.
    met = taken.unionByName(jumps.select(*keys, F.col("then").alias("idx"))).distinct()
    jumps = stored(jumps.join(met, [*keys, "idx"], "left_semi"), "jumps")
    while not jumps.isEmpty():
        reached = taken.join(jumps, [*keys, "idx"]).select(*keys, F.col("then").alias("idx"))
        taken = stored(taken.unionByName(reached), "taken")
        onward = jumps.select(*keys, F.col("idx").alias("then"), F.col("then").alias("beyond"))
        # Many entries wait for the same next one, so those are counted once: the pointer of a target is looked up by target.
        targets = jumps.select(*keys, "then").distinct().join(onward, [*keys, "then"])
        jumps = stored(jumps.join(targets, [*keys, "then"]).select(*keys, "idx", F.col("beyond").alias("then")), "jumps")
    return known.join(taken, [*keys, "idx"], "left_semi")
