"""News records, drawn sequences, positional joins and commonest values against plain readings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions import news as N
from tickloom.operators import stats as S
from tickloom.operators import windows as V
from tickloom.operators.asof import zip_strict
from tickloom.sources.readers import run_sql


def records(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, record string")


def test_calendar_records(spark):
    found = N.calendar_events(
        records(
            spark,
            '{"country": "EU", "date": "2024-03-01", "event": "Rate", "impact": "2", "prev": "4"}',
            '{"country": "US", "date": "2024-03-01T08:30:00+05:00", "impact": "9"}',
            '{"country": "CH", "date": "2024-03-01"}',
            '{"country": "US", "date": "2024"}',
            '{"country": "US"}',
            "no JSON",
            None,
        ),
        "record",
    ).orderBy("id").collect()
    assert [(r["id"], r["time"], r["currency"], r["impact"], r["title"], r["previous"]) for r in found] == [
        (0, dt.datetime(2024, 3, 1), "EUR", "medium", "Rate", "4"),
        (1, dt.datetime(2024, 3, 1, 8, 30), "USD", None, "", ""),
    ]


def test_article_records(spark):
    found = N.article_events(
        records(
            spark,
            '{"title": "a", "seendate": "20240301T101500Z", "tone": -5.1, "sourcecountry": "UK"}',
            '{"title": "b", "seendate": "20240301T101500Z", "tone": 5, "sourcecountry": "GB"}',
            '{"title": "c", "seendate": "20240301T101500Z", "tone": 2}',
            '{"title": "d", "seendate": "20241301T101500Z"}',
            '{"title": "e", "seendate": "20240301"}',
            '{"seendate": "20240301T101500Z"}',
        ),
        "record",
    ).orderBy("id").collect()
    assert [(r["title"], r["impact"], r["currency"]) for r in found] == [("a", "high", "GBP"), ("b", "medium", None), ("c", "low", None)]
    assert found[0]["time"] == dt.datetime(2024, 3, 1, 10, 15)


def test_feed_records(spark):
    rows = records(spark, '{"title": "a", "description": "b"}', '{"title": ""}', "{", None).withColumn("at", F.lit(dt.datetime(2024, 1, 1)))
    assert [(r["title"], r["content"]) for r in N.feed_events(rows, "record", "at").collect()] == [("a", "b")]


def segmented(spark, *sizes):
    rows = [("x", s, i) for s, size in enumerate(sizes) for i in range(100 * s, 100 * s + size)]
    return spark.createDataFrame(rows, "instrument string, segment long, idx long")


def test_draws_without_replacement(spark):
    drawn = [r["start_idx"] for r in V.draw_starts(segmented(spark, 10, 3, 6), 4, 8).collect()]
    assert len(set(drawn)) == 8 and set(drawn) <= {*range(7), 200, 201, 202}
    assert {r["start_idx"] for r in V.draw_starts(segmented(spark, 10, 3, 6), 4, 10).collect()} == {*range(7), 200, 201, 202}


def test_draws_with_replacement(spark):
    drawn = [r["start_idx"] for r in V.draw_starts(segmented(spark, 5, 3), 4, 400).collect()]
    assert len(drawn) == 400 and set(drawn) == {0, 1} and 140 < drawn.count(0) < 260
    with pytest.raises(ValueError):
        V.draw_starts(segmented(spark, 3, 2), 4, 1)


def test_zip_strict(spark):
    left = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b")], "instrument string, idx long, l string")
    right = left.withColumnRenamed("l", "r")
    assert sorted((r["idx"], r["l"], r["r"]) for r in zip_strict(left, right).collect()) == [(0, "a", "a"), (1, "b", "b")]
    for a, b in ((left, right.where("idx = 0")), (left.where("idx = 0"), right)):
        with pytest.raises(Exception, match="different lengths"):
            zip_strict(a, b).collect()


def test_commonest_of_best(spark):
    rows = [("r", 9, 1, "a"), ("r", 8, 2, "b"), ("r", 7, 3, "b"), ("r", 6, 4, "a"), ("r", 5, 5, "c"), ("r", 4, 6, "c"), ("r", 3, 7, "c")]
    params = spark.createDataFrame(rows, "run string, score int, trial int, value string")
    assert [S.commonest_of_best(params, ["run"], "score", "trial", n).first()["value"] for n in (1, 3, 4, 7)] == ["a", "b", "a", "c"]


def test_run_sql(spark):
    value = "x' OR '1' = '1"
    frame = spark.createDataFrame([("x",), (value,)], "name string")
    assert [r[0] for r in run_sql(spark, "SELECT name FROM {t} WHERE name = :n", {"t": frame}, {"n": value}).collect()] == [value]
