"""The first later row of a series that touches a price interval, without forming pairs of rows.

A series is held as a tree of blocks: a block has the rows (or blocks) of the level below as an array with
their lowest and highest values. A query goes up from its own row until a block can hold a touch, then down
to the row, one equi-join a step on the block's number, so the work for a query grows with the logarithm of
the distance and not with the number of rows in between.

Where an interval is open to one side, the first block that can hold a touch has one. Otherwise a block may promise a
touch that no row of it has. Queries so deceived go on after that block, and each further round looks into all promising
parts of blocks of one level more at once, so there are never more rounds than levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.scratch import stored

WIDTH = 32
#: Levels of at most this many blocks are broadcast: 32 cells of 24 bytes each.
FEW_BLOCKS = 16_384


def _levels(rows: DataFrame, keys: Sequence[str], width: int) -> list[DataFrame]:
    """Blocks by level: keys, blk, cells (idx, lo, hi, in order)."""
    longest = rows.agg(F.max("idx")).first()[0]
    cells, out = rows.select(*keys, "idx", "lo", "hi"), []
    reach = 1
    while longest is not None and reach <= longest:
        blocks = cells.groupBy(*keys, F.floor(F.col("idx") / width).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("idx", "lo", "hi"))).alias("cells"))
        level = stored(blocks, "blocks")
        out.append(F.broadcast(level) if level.count() <= FEW_BLOCKS else level)
        lowest, highest = F.array_min(F.transform("cells", lambda c: c["lo"])), F.array_max(F.transform("cells", lambda c: c["hi"]))
        cells = level.select(*keys, F.col("blk").alias("idx"), lowest.alias("lo"), highest.alias("hi"))
        reach *= width
    return out


def _promising(after: Column) -> Column:
    """The cells of a block beyond ``after`` that can hold a touch, in order."""
    near = F.filter("cells", lambda c: (c["idx"] > after) & (c["lo"] <= F.col("to")) & (c["hi"] >= F.col("from")))
    return F.transform(near, lambda c: c["idx"])


def _meet(queries: DataFrame, level: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Queries with the cells of the block they ask for. Those without a question get keys that no block has, each its
    own, so that they meet nothing and do not meet in one task."""
    none = -1 - F.pmod(F.xxhash64("after", "from", "to"), F.lit(1 << 20))
    return queries.withColumn("blk", F.coalesce(block, none)).join(level, [*keys, "blk"], "left")


def _round(todo: DataFrame, levels: list[DataFrame], keys: Sequence[str], width: int, deep: int) -> DataFrame:
    """``todo`` (queries and ``_pos``) with ``_hit``, or with ``_past``, the row up to which nothing was found, where promises failed.

    On levels 1 to ``deep`` all promising cells of a block are looked into, above only the first.
    """

    def chosen(number: int) -> Column:
        return F.col("_near") if 1 <= number <= deep else F.slice("_near", 1, 1)

    at = todo.withColumns({"_at": F.col("_pos"), "_found": F.lit(None).cast("int"), "_cells": F.lit(None).cast("array<long>")})
    for number, level in enumerate(levels):
        asking = F.when(F.col("_found").isNull(), F.floor(F.greatest("_at", F.lit(0)) / width))
        met = _meet(at, level, keys, asking).withColumn("_near", _promising(F.col("_at")))
        fresh = F.col("_found").isNull() & (F.size(F.coalesce("_near", F.array())) > 0)
        at = met.withColumns(
            {"_cells": F.when(fresh, chosen(number)).otherwise(F.col("_cells")), "_found": F.when(fresh, number).otherwise(F.col("_found")), "_at": F.when(F.col("blk") >= 0, F.col("blk")).otherwise(F.col("_at"))}
        ).drop("blk", "cells", "_near")
    at = at.withColumn("_past", F.lit(None).cast("long")).drop("_at")
    for number in range(len(levels) - 1, 0, -1):
        going = (F.col("_found") >= number) & F.col("_past").isNull()
        single = at.withColumn("_cell", F.explode_outer("_cells")) if deep else at.withColumn("_cell", F.get("_cells", F.lit(0)))
        met = _meet(single, levels[number - 1], keys, F.when(going, F.col("_cell"))).withColumn("_near", F.coalesce(_promising(F.lit(-1)), F.array().cast("array<long>")))
        failed = going & (F.size("_near") == 0)
        at = met.withColumns(
            {"_past": F.when(failed, (F.col("blk") + 1) * width**number - 1).otherwise(F.col("_past")), "_cells": F.when(going, chosen(number - 1)).otherwise(F.array("_cell"))}
        ).drop("blk", "cells", "_near", "_cell")
    return at.withColumn("_hit", F.when(F.col("_past").isNull(), F.get("_cells", F.lit(0)))).drop("_cells", "_found")


def first_touch(queries: DataFrame, rows: DataFrame, keys: Sequence[str] = ("instrument",), width: int = WIDTH) -> DataFrame:
    """``queries`` (keys, after, from, to, and more) with ``hit_idx``: the first idx beyond ``after`` with lo <= to and hi >= from.

    ``rows`` has the keys, idx (dense, from 0), lo and hi.
    """
    levels = _levels(rows, keys, width)
    at = stored(_round(queries.withColumn("_pos", F.col("after")), levels, keys, width, 0), "touch")
    done, deep = at.where("_past is null").select(*queries.columns, F.col("_hit").alias("hit_idx")), 0
    left = at.where("_past is not null")
    while not left.isEmpty():
        deep += 1
        todo = stored(left.select(*queries.columns, F.col("_past").alias("_pos")).withColumn("_query", F.monotonically_increasing_id()), "deceived")
        paths = _round(todo, levels, keys, width, deep).groupBy("_query").agg(F.min("_hit").alias("_hit"), F.max("_past").alias("_past"))
        at = stored(todo.drop("_pos").join(paths, "_query"), "touch")
        over = F.col("_hit").isNotNull() | F.col("_past").isNull()
        done = done.unionByName(at.where(over).select(*queries.columns, F.col("_hit").alias("hit_idx")))
        left = at.where(~over)
    return done
