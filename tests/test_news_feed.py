"""The news feed is all events; replies are read by their protocol."""

from pyspark.sql import functions as F

from tickloom.functions import news as N
from tickloom.plans.joins import news

SMALL = "/root/testdata/sf0.001"


def test_all_events_are_news(spark):
    assert news(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    parsed = N.parse_reply(F.col("text"))
    return [r for r in df.select("n", *[c.alias(k) for k, c in parsed.items()]).orderBy("n").collect()]


def test_replies(spark):
    full, block, odd, none = read(
        spark,
        "ACTION: directional\nIMPACT_SCORE: 0.85\nINSTRUMENTS:\n  EUR/USD: bullish\n  NIKKEI225: bearish\n  DAX: BULLISH\nREASONING: hike: a surprise",
        "INSTRUMENTS:\n A: none\n B: bearish\nACTION: tighten_stops\nC: bullish",
        "\n  action: pause\nACTION: close everything\nIMPACT_SCORE: high\nSENTIMENT: Bullish",
        None,
    )
    assert (full.action, full.score, full.sentiment, full.reasoning) == ("directional", 0.85, "bullish", "hike: a surprise")
    assert full.sentiments == {"EUR/USD": "bullish", "NIKKEI225": "bearish", "DAX": "bullish"}
    assert (block.action, block.sentiment, block.sentiments) == ("tighten_stops", "bearish", {"A": "none", "B": "bearish"})
    assert (odd.action, odd.score, odd.sentiment, odd.sentiments) == ("none", 0.0, "bullish", {})
    assert (none.action, none.score, none.sentiment, none.reasoning) == ("none", 0.0, "neutral", "")


def test_stored_actions(spark):
    names = ["none", "pause", "tighten_stops", "directional", "trigger_entry", "close_opposing", "tighten", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(N.known_action(F.col("name"))).collect()] == [*names[:4], "directional", "directional", "none", "none"]
