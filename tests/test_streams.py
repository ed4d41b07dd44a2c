"""Streams give the same rows however a feed is cut into files, and after a restart; what is late is counted."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.bars import candles
from tickloom.plans import live as live_plans
from tickloom.streaming import live as L
from tickloom.streaming.detectors import Series, detected
from tickloom.streaming.health import Health, observed
from tickloom.streaming import labels
from tickloom.streaming.labels import OPEN, Barriers, stream_labels
from tickloom.streaming.news import under_news

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double"
RULES = (2, 14, 1.5, 2.0)
#: slices, files a slice: one file, files in order, files that share all rows at random.
CUTS = [(1, 1), (3, 2), (1, 6)]


@pytest.fixture(scope="module")
def events(spark):
    rng, rows, at = random.Random(4), [], START
    for i in range(600):
        at += timedelta(microseconds=rng.choice([0, rng.randrange(1, 4_000_000_000)]))
        rows.append((i, at, rng.choice(["a", "b"]), round(rng.gauss(100, 3), 2)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EVENTS).cache()


def ticks(events):
    out = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        out.setdefault(r.event_type, []).append((int((r.ts - START) / timedelta(microseconds=1)), r.event_id, r.value - 0.25, r.value + 0.25))
    return out


def labels_by_hand(events, stop, target, span):
    def drift(points):
        points = round(points, 9)
        return 1 if points > 0 else 0 if points < 0 else -1

    def side(rows, i, lost, won, worth):
        for now, _, bid, ask in rows[i + 1 :]:
            if lost(bid, ask):
                return 0
            if won(bid, ask):
                return 1
            if now - rows[i][0] > span:
                return drift(worth(bid, ask))
        return None

    out = []
    for name, rows in ticks(events).items():
        for i, (_, seq, own_bid, own_ask) in enumerate(rows):
            buy = side(rows, i, lambda b, a: b <= own_ask - stop, lambda b, a: b >= own_ask + target, lambda b, a: b - own_ask)
            sell = side(rows, i, lambda b, a: a >= own_bid + stop, lambda b, a: a <= own_bid - target, lambda b, a: own_bid - a)
            if buy is not None and sell is not None:
                out.append((name, seq, buy, sell))
    return sorted(out)


@pytest.mark.parametrize("slices, files", CUTS)
def test_labels(spark, events, slices, files):
    feed = L.in_slices(events, "ts", slices, "feed", files, mark=timedelta(days=1))
    got = L.drained(stream_labels(L.tick_stream(spark, feed.path), 4.0, 5.0, 3600 * 6, feed.lateness()), "labels", rocks=True)
    assert sorted(map(tuple, got.rows.collect())) == labels_by_hand(events, 4.0, 5.0, 3600 * 6 * 10**6)
    assert sum(got.counted("numRowsDroppedByWatermark")) == 0


@pytest.mark.parametrize("slices, files", CUTS)
def test_detectors(spark, events, slices, files):
    ticked = L.tick_columns_of(events)
    bars = candles(ticked, "1 hour").withColumn("timeframe", F.lit("1h")).cache()
    want = []
    for name in ("a", "b"):
        series = Series(None, *RULES)
        for r in bars.where(F.col("instrument") == name).orderBy("time").collect():
            want += [(name, e[0], e[2], round(e[3], 6), round(e[4], 6)) for e in series.add(int(r.time.timestamp()), r.open, r.high, r.low, r.close)]
    feed = L.in_slices(bars, "time", slices, "bars", files, mark=timedelta(days=1))
    stream = L.read_feed(spark, feed.path).withColumn("time", F.col("time").cast("timestamp"))
    got = L.drained(detected(stream, feed.lateness()), "found", rocks=True).rows.collect()
    assert sorted((r.instrument, r.detector, r.kind, round(r.upper, 6), round(r.lower, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("slices, files", CUTS)
def test_bars_leave_once_and_take_their_state_along(spark, events, slices, files):
    feed = L.in_slices(events, "ts", slices, "feed", files, mark=timedelta(days=1))
    got = L.drained(L.stream_bars(L.tick_stream(spark, feed.path), "1 hour", feed.lateness()), "bars")
    want = candles(L.tick_columns_of(events), "1 hour")
    columns = ["instrument", "time", "open", "high", "low", "close", "tick_count"]
    rows = got.rows.withColumn("time", F.col("time").cast("timestamp_ntz")).select(columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert sum(got.counted("numRowsRemoved")) == want.count()
    assert got.counted("numRowsTotal")[-1] <= 1  # the mark alone
    if slices > 1:
        assert max(got.counted("numRowsTotal")) < 0.9 * want.count()


def test_late_rows_are_counted_and_left_out(spark, events):
    """Two slices; a third file then brings rows of the first one again, which the watermark has passed."""
    feed = L.in_slices(events, "ts", 2, "feed")
    middle = START + feed.disorder
    place = f"{feed.path}-run"
    stream = lambda: L.stream_bars(L.tick_stream(spark, feed.path), "1 hour", "1 hour")
    L.drained(stream(), "bars", place=place)
    late = events.where(F.col("ts") < F.lit(middle - timedelta(hours=30)))
    late.coalesce(1).write.parquet(f"{feed.path}/late")
    got = L.drained(stream(), "bars", place=place)
    assert sum(got.counted("numRowsDroppedByWatermark")) > 0
    want = {(r.instrument, r.time): r.tick_count for r in candles(L.tick_columns_of(events), "1 hour").withColumn("time", F.col("time").cast("timestamp")).collect()}
    rows = got.rows.collect()
    assert len({(r.instrument, r.time) for r in rows}) == len(rows) > 0
    assert all(want[r.instrument, r.time] == r.tick_count for r in rows)


def test_restart_gives_no_row_twice(spark, events, tmp_path):
    """Half of the feed, a stop, the other half: as if it had never stopped."""
    feed = L.in_slices(events, "ts", 4, "feed", 2, mark=timedelta(days=1))
    folder, place = str(tmp_path / "feed"), str(tmp_path / "run")
    for part in (["slice=0000", "slice=0001"], ["slice=0002", "slice=0003"], ["slice=0004"]):
        for name in part:
            spark.read.parquet(f"{feed.path}/{name}").write.parquet(f"{folder}/{name}")
        got = L.drained(stream_labels(L.tick_stream(spark, folder), 4.0, 5.0, 3600 * 6, feed.lateness()), "labels", place=place, rocks=True)
    assert sorted(map(tuple, got.rows.collect())) == labels_by_hand(events, 4.0, 5.0, 3600 * 6 * 10**6)


def test_sorted_barriers_keep_only_open_quotes():
    rng, barriers, out = random.Random(1), Barriers(2.0, 3.0, 50), []
    for now in range(2000):
        mid = 100 + rng.gauss(0, 1)
        out += barriers.add(now, now, mid - 0.1, mid + 0.1)
        assert len(barriers.pending()) <= 51
        if now % 100 == 0:
            barriers = Barriers(2.0, 3.0, 50, barriers.pending())
    assert len({q[1] for q in out}) == len(out) >= 1940 and all(OPEN not in q[4:] for q in out)


def test_quotes_meet_the_news_that_acts(spark, events):
    feed = L.in_slices(events, "ts", 3, "feed", 2, mark=timedelta(days=1))
    quotes = L.tick_stream(spark, feed.path)
    news = L.read_feed(spark, feed.path).where((F.col("event_id") % 4 == 0) | (F.col("event_type") == L.MARK)).select(F.col("event_type").alias("currency"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("id"), F.lit("pause").alias("action"))
    got = L.drained(under_news(quotes, news, 60, feed.lateness()), "news")
    own = events.collect()
    want = []
    for q in own:
        met = [n.event_id for n in own if n.event_id % 4 == 0 and n.event_type == q.event_type and n.ts <= q.ts < n.ts + timedelta(hours=1)]
        want += [(q.event_type, q.event_id, i) for i in met or [None]]
    assert sorted(map(repr, ((r.instrument, r.seq, r.id) for r in got.rows.collect()))) == sorted(map(repr, want))
    assert got.counted("numRowsTotal")[-1] <= 4


def test_health_has_every_row_once(spark, events):
    feed = L.in_slices(events, "ts", 3, "feed")
    with Health(spark) as health:
        L.drained(L.stream_bars(observed(L.tick_stream(spark, feed.path)), "1 hour", feed.lateness()), "bars")
    rows = health.table().collect()
    assert sum(r.rows for r in rows) == events.count() and len({r.batch for r in rows}) == len(rows)
    assert max(r.state_rows for r in rows) > 0 and {r.dropped for r in rows} == {0}


@pytest.mark.parametrize("part_rows", [L.PART_ROWS, 20])
def test_a_slice_is_whole_micro_batches_however_the_table_is_stored(spark, events, monkeypatch, part_rows):
    monkeypatch.setattr(L, "PART_ROWS", part_rows)
    late = events.where(F.col("ts") > F.lit(START + timedelta(days=2))).unionByName(events.limit(3))  # few rows in the first slices
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        feed = L.in_slices(late, "ts", 3, "feed")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    with Health(spark) as health:
        L.drained(L.stream_bars(observed(L.tick_stream(spark, feed.path, getattr(feed, "parts", 1))), "1 hour", feed.lateness()), "bars")
    first, last, n = late.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    width = (last - first) // 3 + timedelta(microseconds=1)
    want = {}
    for r in late.collect():
        want[(r.ts - first) // width] = want.get((r.ts - first) // width, 0) + 1
    assert {r.batch: r.rows for r in health.table().collect() if r.rows} == want and sum(want.values()) == n


def test_quotes_meet_only_news_of_their_span(spark, events):
    told = events.select(F.col("event_type").alias("currency"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("id"), F.lit("pause").alias("action"))
    quotes = L.tick_columns_of(events).withColumn("time", F.col("time").cast("timestamp"))
    plan = under_news(quotes, told, 15, "1 hour")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert join.count(" = ") == 2  # the instrument and the span of time


def test_state_of_quotes_and_news_has_a_row_a_span(spark):
    own = [(i, START + timedelta(seconds=9 * i), "a", 1.0) for i in range(400)]  # four spans of 15 minutes
    feed = L.in_slices(spark.createDataFrame(own, EVENTS), "ts", 2, "feed", 2, mark=timedelta(days=1))
    told = L.read_feed(spark, feed.path).select(F.col("event_type").alias("currency"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("id"), F.lit("pause").alias("action"))
    got = L.drained(under_news(L.tick_stream(spark, feed.path), told, 15, feed.lateness()), "news")
    want = [(q, n) for q in range(400) for n in range(400) if 0 <= 9 * (q - n) < 900]
    assert sorted((r.seq, r.id) for r in got.rows.collect()) == sorted(want)
    assert max(got.counted("numRowsTotal")) <= 4 + 5 + 3 + 9  # packed quotes, packed news, the mark's, and what is meeting


@pytest.mark.parametrize("cut, block", [(1, 4), (7, 4), (400, 16), (400, 1 << 16)])
def test_blocks_of_ticks_are_labelled_as_tick_by_tick(monkeypatch, cut, block):
    """Quotes that are carried from release to release, and ties of time."""
    monkeypatch.setattr(labels, "BLOCK", block)
    rng, barriers, told = random.Random(2), Barriers(2.0, 3.0, 50), []
    rows, now, price = [], 0, 100.0
    for seq in range(400):
        now += rng.choice((0, 1, 3, 70 if seq % 90 == 0 else 2))
        price += rng.choice((-1.5, -0.5, 0.0, 0.5, 1.5))
        rows.append((now, seq, price - 0.25, price + 0.25))
        told += [(q[1], q[4], q[5]) for q in barriers.add(*rows[-1])]
    ticks = np.array(rows, dtype=[("time", "<i8"), ("seq", "<i8"), ("bid", "<f8"), ("ask", "<f8")])
    got, pending = [], np.empty(0, dtype=labels.QUOTES)
    for at in range(0, len(ticks), cut):
        done, pending = labels.settled(pending, ticks[at : at + cut], 2.0, 3.0, 50)
        got += done[["seq", "buy", "sell"]].tolist()
    assert sorted(got) == sorted(told) and len(got) > 300
    assert pending["seq"].tolist() == [q[1] for q in barriers.pending()]


def test_a_price_that_is_not_a_number_holds_up_no_other():
    rows = [(n, n, float("nan") if n == 20 else 100.0 - n % 7, 101.0 - n % 7) for n in range(200)]
    ticks = np.array(rows, dtype=[("time", "<i8"), ("seq", "<i8"), ("bid", "<f8"), ("ask", "<f8")])
    done, pending = labels.settled(np.empty(0, dtype=labels.QUOTES), ticks, 2.0, 3.0, 50)
    assert len(done) + len(pending) == 200 and pending["time"].min() >= 199 - 50
    assert done[done["seq"] == 20][["buy", "sell"]].tolist() == [(1, -1)]


def test_feeds_of_quotes_hold_what_quotes_are_made_of(spark):
    feed = live_plans._feed(spark, "/root/testdata/sf0.001")
    dropped = spark.read.option("recursiveFileLookup", True).parquet(feed.path)
    assert set(dropped.columns) == {"event_id", "ts", "event_type", "value"}
    assert dropped.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() + 1
