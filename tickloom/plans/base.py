"""The driver tables seen as market data, for Spark and as SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import candles
from tickloom.operators.series import with_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TICKS = "ticks AS (SELECT event_type AS instrument, ts AS time, event_id AS seq, value AS mid, value - 0.25 AS bid, value + 0.25 AS ask FROM events)"


def bars_sql(name: str, width: str) -> str:
    """CTE of candles with idx."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time) - 1 AS idx FROM (
      SELECT instrument, time_bucket(INTERVAL '{width}', time) AS time, first(mid ORDER BY time, seq) AS open, max(mid) AS high, min(mid) AS low,
             last(mid ORDER BY time, seq) AS close, count(*) AS tick_count, last(ask - bid ORDER BY time, seq) AS spread
      FROM ticks GROUP BY 1, 2))"""


BARS = f"{TICKS}, {bars_sql('bars', '1 hour')}"
TRADES = """trades AS (SELECT o_orderkey AS trade_id, o_custkey AS account, o_orderdate AS opened_at, o_orderpriority AS source, o_totalprice AS entry_price,
      round(sum(l_extendedprice::DECIMAL(15, 2) * (l_discount::DECIMAL(4, 2) - 0.05)), 2)::DOUBLE AS pnl, sum(l_quantity) AS size
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes: the event type is the instrument."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        value.alias("mid"),
        (value - 0.25).alias("bid"),
        (value + 0.25).alias("ask"),
    )


def raw_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    return candles(ticks(spark, sf_dir), width)


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    return with_index(raw_bars(spark, sf_dir, width))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed trades: profit from their line items, summed in decimals, as half cents do occur."""
    profit = F.col("l_extendedprice").cast("decimal(15,2)") * (F.col("l_discount").cast("decimal(4,2)") - F.lit(0.05).cast("decimal(4,2)"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum(profit), 2).cast("double").alias("pnl"), F.sum("l_quantity").alias("size")
    )
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    return joined.select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").alias("opened_at"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_totalprice").alias("entry_price"),
        "pnl",
        "size",
    )


def rounded(*columns: str, places: int = 6):
    return [F.round(F.col(c), places).alias(c) for c in columns]
