"""Roll-ups that are kept up to date: only buckets that a load has touched are computed again.

A store is a folder with the quotes by instrument and day, hourly bars by instrument and day, daily bars by instrument and
month, and two logs. A load writes down which days it is about to replace, then replaces them; a refresh computes the
days that were written down since the refresh before it. A load or refresh that was cut off is simply run again: what it
had done is done once more, to the same end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import candles, roll_up

QUOTES = "instrument string, time timestamp_ntz, seq long, mid double, bid double, ask double, day string"
BARS = "instrument string, time timestamp_ntz, open double, high double, low double, close double, tick_count long, spread double"
CHANGES, REFRESHES = "load long, instrument string, day string, action string", "upto long"
DAY = ["instrument", "day"]
#: Changed partitions up to this number are broadcast, which also prunes the folders that are read.
FEW = 100_000


class RollUps:
    """The store at ``path``. ``complete``: a stored day with more quotes than that is not loaded again, unless corrected."""

    def __init__(self, spark: SparkSession, path: str, complete: int = 50_000):
        self.spark, self.path, self.complete = spark, path.rstrip("/"), complete

    def table(self, name: str) -> DataFrame:
        """quotes, hours or days."""
        return self._read(name, QUOTES if name == "quotes" else f"{BARS}, {'day' if name == 'hours' else 'month'} string")

    def _read(self, name: str, schema: str) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _replace(self, df: DataFrame, name: str, by: list[str]) -> None:
        """Overwrite the partitions that ``df`` has rows of; a partition with many rows is dealt over several tasks."""
        dealt = df.hint("rebalance", *by)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def load(self, quotes: DataFrame, correct: bool = False) -> DataFrame:
        """Take over ``quotes`` day by day, and say what happened to each day: new, reloaded (it was partial or is corrected) or skipped.

        A day is replaced as a whole, so what a broken load left of it goes.
        """
        dated = quotes.select("instrument", "time", "seq", "mid", "bid", "ask", F.date_format("time", "yyyy-MM-dd").alias("day"))
        stored = self.table("quotes").groupBy(*DAY).agg(F.count("*").alias("stored"))
        full = F.lit(False) if correct else F.col("stored") > self.complete
        action = F.when(F.col("stored").isNull(), "new").when(full, "skipped").otherwise("reloaded")
        number = (self._read("changes", CHANGES).agg(F.max("load")).first()[0] or 0) + 1
        days = dated.select(*DAY).distinct().join(stored, DAY, "left")
        days.select(F.lit(number).cast("long").alias("load"), *DAY, action.alias("action")).write.mode("append").parquet(f"{self.path}/changes")
        told = self._read("changes", CHANGES).where(F.col("load") == number)
        self._replace(_of(dated, told.where("action <> 'skipped'"), DAY), "quotes", DAY)
        return told

    def refresh(self) -> DataFrame:
        """Compute the hours of the days changed since the last refresh, and the days of their months; returns what was changed."""
        upto = self._read("refreshes", REFRESHES).agg(F.max("upto")).first()[0] or 0
        fresh = self._read("changes", CHANGES).where((F.col("load") > upto) & (F.col("action") != "skipped"))
        changed = fresh.select(*DAY).distinct()
        last = fresh.agg(F.max("load")).first()[0]
        if last is None:
            return changed
        hours = candles(_of(self.table("quotes"), changed, DAY).drop("day"), "1 hour")
        self._replace(hours.withColumn("day", F.date_format("time", "yyyy-MM-dd")), "hours", DAY)
        months = changed.select("instrument", F.substring("day", 1, 7).alias("month")).distinct()
        touched = _of(self.table("hours").withColumn("month", F.substring("day", 1, 7)), months, ["instrument", "month"])
        days = roll_up(touched.drop("day", "month"), "1 day")
        self._replace(days.withColumn("month", F.date_format("time", "yyyy-MM")), "days", ["instrument", "month"])
        self.spark.createDataFrame([(last,)], REFRESHES).write.mode("append").parquet(f"{self.path}/refreshes")
        return changed


def _of(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` in the listed partitions."""
    return df.join(F.broadcast(parts.select(*keys)) if parts.count() <= FEW else parts.select(*keys), keys, "left_semi")
