"""Roll-ups after loads and corrections against a full rebuild, and what a refresh leaves alone."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators.bars import candles, roll_up
from tickloom.operators.refresh import RollUps

SCHEMA = "instrument string, time timestamp_ntz, seq long, mid double, bid double, ask double"
START = datetime(2024, 1, 30)


def quotes(spark, days, every=20, shift=0.0, names=("a", "b")):
    rows = [(n, START + timedelta(days=d, minutes=every * m), d * 10_000 + m, 100 + shift + (d * 7 + m * 3) % 11, 99.0, 101.0) for n in names for d in days for m in range(1440 // every)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("instrument", "time", "open", "high", "low", "close", "tick_count").collect())))


def files(store, name):
    own = store.table(name).select("instrument", "day" if name != "days" else "month", "_metadata.file_path", "_metadata.file_modification_time").distinct().collect()
    return {tuple(r) for r in own}


def test_three_loads(spark, tmp_path):
    store = RollUps(spark, str(tmp_path / "store"), complete=60)
    partial = quotes(spark, [0, 1]).unionByName(quotes(spark, [2], every=60))
    assert {r.action for r in store.load(partial).collect()} == {"new"}
    store.refresh()
    again = {(r.instrument, r.day): r.action for r in store.load(quotes(spark, [1, 2, 3], shift=1.0)).collect()}
    assert again["a", "2024-01-31"] == "skipped" and again["a", "2024-02-01"] == "reloaded" and again["b", "2024-02-02"] == "new"
    before = files(store, "hours")
    assert store.refresh().count() == 4
    assert {f for f in before if f[1] < "2024-02-01"} == {f for f in files(store, "hours") if f[1] < "2024-02-01"}
    hours, months = files(store, "hours"), files(store, "days")
    store.load(quotes(spark, [2], shift=5.0, names=["a"]), correct=True)
    assert store.refresh().count() == 1 and store.refresh().count() == 0
    assert {f for f in hours if f[:2] != ("a", "2024-02-01")} == {f for f in files(store, "hours") if f[:2] != ("a", "2024-02-01")}
    assert {f for f in months if f[:2] != ("a", "2024-02")} == {f for f in files(store, "days") if f[:2] != ("a", "2024-02")}
    whole = quotes(spark, [0, 1]).unionByName(quotes(spark, [2, 3], shift=1.0)).where("not (instrument = 'a' and seq between 20000 and 29999)").unionByName(quotes(spark, [2], shift=5.0, names=["a"]))
    assert rows(store.table("hours")) == rows(candles(whole, "1 hour"))
    assert rows(store.table("days")) == rows(roll_up(candles(whole, "1 hour"), "1 day"))


def test_a_load_that_was_cut_off_is_made_good(spark, tmp_path):
    """The days were written down, and the quotes of one of them were not yet replaced."""
    store = RollUps(spark, str(tmp_path / "store"))
    store.load(quotes(spark, [0]))
    store.refresh()
    day = [("a", "2024-01-31"), ("b", "2024-01-31")]
    spark.createDataFrame([(2, *d, "new") for d in day], "load long, instrument string, day string, action string").write.mode("append").parquet(f"{store.path}/changes")
    store.refresh()
    store.load(quotes(spark, [1]))
    store.refresh()
    assert rows(store.table("hours")) == rows(candles(quotes(spark, [0, 1]), "1 hour"))
    assert store.table("hours").where(F.col("day") == "2024-01-30").count() == 48
