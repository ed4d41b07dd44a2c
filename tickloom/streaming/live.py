"""Feeds as streams: what arrives in files, bars that leave once, and what a run reports.

A feed may be out of order by ``lateness``. The watermark follows the latest row by that much: what is older is late, is
dropped and counted, and what lies behind it is complete, leaves in append mode and takes its state along.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.bars import candles
from tickloom.sources.scratch import scratch_path, stored

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the last row of a marked feed has in its text columns; it needs a value, as joins pass over nulls.
MARK = "\x00end of feed"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS_CONF = "spark.sql.shuffle.partitions"
#: Rows of one file of a feed, about.
PART_ROWS = 500_000


@dataclass
class Feed:
    """A folder that files were dropped into, and how far its rows may be out of order."""

    path: str
    disorder: timedelta
    #: Files of one micro-batch.
    parts: int = 1

    def lateness(self) -> str:
        """The disorder in whole milliseconds, as watermarks are kept, rounded up on both of its ends."""
        return f"{self.disorder // timedelta(milliseconds=1) + 2} milliseconds"


def in_slices(df: DataFrame, at: str, slices: int, label: str, files: int = 1, mark: timedelta = timedelta(0)) -> Feed:
    """``df`` dropped into a folder slice by slice in order of time, each slice as ``files`` micro-batches that share its rows.

    Micro-batches of one slice come in any order, so rows may be out of order by its width. A micro-batch is ``parts`` files,
    so that tasks write and read it side by side; each slice has exactly ``files * parts`` of them, some without rows where
    it has few, so no micro-batch reaches into the next slice. The table is sorted and written once; a slice reads from it
    what its times ask for. With ``mark``, a last file has one row of ``MARK`` and zeros that much beyond the disorder, which
    tells that everything before it has come.
    """
    spark, place = df.sparkSession, scratch_path(df.sparkSession, label)
    rows = stored(df.repartitionByRange(at).sortWithinPartitions(at), f"{label}-sorted")
    kind = rows.schema[at].dataType
    first, last, count = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    if first is None:
        rows.coalesce(1).write.parquet(f"{place}/slice=0000")
        return Feed(place, timedelta(0))
    width = (last - first) // slices + timedelta(microseconds=1)
    parts = -(-count // (slices * files * PART_ROWS))
    for number in range(slices):
        low, high = (F.lit(first + n * width).cast(kind) for n in (number, number + 1))
        part, folder = rows.where((F.col(at) >= low) & (F.col(at) < high)), f"{place}/slice={number:04d}"
        (part.coalesce(1) if files * parts == 1 else part.repartition(files * parts, F.rand(1))).write.parquet(folder)
        for _ in range(files * parts - _files(spark, folder)):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    if mark:
        fill = {T.StringType(): MARK, kind: last + 2 * width + mark}
        row = [last + 2 * width + mark if f.name == at else fill.get(f.dataType, 0 if isinstance(f.dataType, T.IntegralType) else 0.0) for f in rows.schema]
        spark.createDataFrame([tuple(row)], rows.schema).coalesce(1).write.parquet(f"{place}/slice={slices:04d}")
    return Feed(place, width, parts)


def _files(spark: SparkSession, folder: str) -> int:
    """How many data files a folder has."""
    return len(spark.read.parquet(folder).inputFiles())


def read_feed(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The files of a feed as a stream, the oldest first."""
    schema = spark.read.option("recursiveFileLookup", True).parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).parquet(path)


def tick_columns_of(events: DataFrame) -> DataFrame:
    """Events as quotes, which their type names the instrument of."""
    value = F.col("value")
    return events.select(
        F.col("event_type").alias("instrument"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        value.alias("mid"),
        (value - 0.25).alias("bid"),
        (value + 0.25).alias("ask"),
    )


def tick_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream of quotes."""
    return tick_columns_of(read_feed(spark, path, per_trigger)).withColumn("time", F.col("time").cast("timestamp"))


def stream_bars(stream: DataFrame, width: str, lateness: str) -> DataFrame:
    """Candles that leave when the watermark passes their end; the aggregation is the batch one."""
    return candles(stream.withWatermark("time", lateness), width)


@dataclass
class Drained:
    """What a stream gave (without the mark of its feed), and the progress of each micro-batch."""

    rows: DataFrame
    batches: list[dict] = field(default_factory=list)

    def counted(self, name: str) -> list[int]:
        """A figure of the stateful operators, batch by batch: numRowsTotal, numRowsRemoved, numRowsDroppedByWatermark."""
        return [sum(o[name] for o in b["stateOperators"]) for b in self.batches]


def drained(stream: DataFrame, label: str, mode: str = "append", key: str | None = "instrument", place: str | None = None, rocks: bool = False) -> Drained:
    """Run a stream over what is there now. Rows whose ``key`` is the mark of a feed are left out.

    Each micro-batch overwrites a folder of its own number, so a repeated batch leaves no second copy. A run at the same
    ``place`` goes on where the one before it ended. ``rocks``: state is kept in RocksDB, which processors with timers
    need; otherwise in the store of the session. Every micro-batch opens each store of each partition, whatever it holds, so
    there are no more partitions than tasks that run at once.
    """
    spark = stream.sparkSession
    place = place or scratch_path(spark, label)
    schema = stream.schema

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/part={number}")

    before = {c: spark.conf.get(c) for c in (STORE_CONF, PARTITIONS_CONF)}
    spark.conf.set(STORE_CONF, ROCKS if rocks else before[STORE_CONF])
    spark.conf.set(PARTITIONS_CONF, min(int(before[PARTITIONS_CONF]), spark.sparkContext.defaultParallelism))
    try:
        run = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{place}/marks").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    found = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{place}/out")
    return Drained(found.where(~F.col(key).eqNullSafe(MARK)) if key else found, [dict(p.jsonValue) if hasattr(p, "jsonValue") else p for p in run.recentProgress])
