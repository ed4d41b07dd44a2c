"""Queries: news records, drawn sequences, positional joins, SQL texts, commonest parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import news as N
from tickloom.operators import stats as S
from tickloom.operators import table_functions
from tickloom.operators import windows as V
from tickloom.operators.asof import zip_strict
from tickloom.operators.series import with_index
from tickloom.plans.base import BARS, bars, query, raw_bars, rounded, table
from tickloom.plans.signals import SEGMENTS
from tickloom.sources import readers as R
from tickloom.sources.news_lines import NewsLines
from tickloom.sources.scratch import scratch_path
from tickloom.streaming.live import drained

CALENDAR = (
    '{"country": "US", "date": "<day>", "event": "CPI <id>", "impact": "3", "actual": "<id>", "estimate": 0.25, "prev": null}',
    '{"country": "GB", "date": "<day> 08:30:00", "event": "Rate", "impact": "2"}',
    '{"country": "FR", "date": "<day>T09:15:00", "event": "PMI", "impact": "9", "actual": "a \\"b\\""}',
    '{"country": "CH", "date": "<day>", "event": "Rate", "impact": "1"}',
    '{"country": "JP", "date": "soon", "event": "Rate", "impact": "1"}',
    '{"country": "DE", "date": "<day>", "impact": 1}',
)
ARTICLES = (
    '{"title": "Banks <id>", "seendate": "<plain>T101500Z", "tone": -6.5, "sourcecountry": "UK", "url": "u/<id>"}',
    '{"title": "Oil", "seendate": "<plain>T000000Z", "tone": "2.5", "sourcecountry": "NO"}',
    '{"title": "Gold", "seendate": "<plain>", "tone": 1}',
    '{"title": "", "seendate": "<plain>T101500Z"}',
    '{"title": "Yen", "seendate": "<plain>T235959Z", "sourcecountry": "JP"}',
)
FEED = ('{"title": "Fed <id>", "description": "d"}', '{"title": null}', "no JSON <id>", '{"title": "ECB"}')


def _records(spark, sf_dir, texts):
    """A record for each event, with its id and day in it."""
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % len(texts) + 1).cast("int"))
    for mark, value in (("<id>", F.col("event_id").cast("string")), ("<day>", F.date_format("ts", "yyyy-MM-dd")), ("<plain>", F.date_format("ts", "yyyyMMdd"))):
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf_dir, "events").select("event_id", text.alias("record"))


def _records_sql(texts):
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"""t AS (SELECT event_id, ts, replace(replace(replace(([{listed}])[event_id % {len(texts)} + 1], '<id>', event_id::VARCHAR), '<day>', strftime(ts, '%Y-%m-%d')), '<plain>', strftime(ts, '%Y%m%d')) AS text FROM events),
    r AS (SELECT event_id, ts, CASE WHEN json_valid(text) THEN text ELSE '{{}}' END::JSON AS j FROM t)"""


@query(
    "calendar_records",
    f"""WITH {_records_sql(CALENDAR)} SELECT event_id, try_cast(j->>'date' AS TIMESTAMP) AS time, 'calendar' AS source, 'economic_calendar' AS event_type, coalesce(j->>'event', '') AS title,
    CASE WHEN j->>'country' = 'US' THEN 'USD' WHEN j->>'country' = 'GB' THEN 'GBP' WHEN j->>'country' = 'JP' THEN 'JPY' ELSE 'EUR' END AS currency,
    coalesce(j->>'actual', '') AS actual, coalesce(j->>'estimate', '') AS forecast, coalesce(j->>'prev', '') AS previous, CASE j->>'impact' WHEN '1' THEN 'low' WHEN '2' THEN 'medium' WHEN '3' THEN 'high' END AS impact
    FROM r WHERE j->>'country' IN ('US', 'EU', 'GB', 'JP', 'DE', 'FR') AND try_cast(j->>'date' AS TIMESTAMP) IS NOT NULL""",
)
def calendar_records(spark, sf_dir):
    return N.calendar_events(_records(spark, sf_dir, CALENDAR), "record")


@query(
    "article_records",
    f"""WITH {_records_sql(ARTICLES)}, a AS (SELECT *, try_strptime(j->>'seendate', '%Y%m%dT%H%M%SZ') AS time, coalesce(try_cast(j->>'tone' AS DOUBLE), 0) AS tone FROM r)
    SELECT event_id, time, 'articles' AS source, 'breaking_news' AS event_type, j->>'title' AS title, coalesce(j->>'url', '') AS content,
    CASE j->>'sourcecountry' WHEN 'US' THEN 'USD' WHEN 'UK' THEN 'GBP' WHEN 'EU' THEN 'EUR' WHEN 'JP' THEN 'JPY' WHEN 'DE' THEN 'EUR' WHEN 'FR' THEN 'EUR' END AS currency, tone,
    CASE WHEN abs(tone) > 5 THEN 'high' WHEN abs(tone) > 2 THEN 'medium' ELSE 'low' END AS impact FROM a WHERE time IS NOT NULL AND j->>'title' <> ''""",
)
def article_records(spark, sf_dir):
    return N.article_events(_records(spark, sf_dir, ARTICLES), "record")


@query("feed_records", f"WITH {_records_sql(FEED)} SELECT event_id, ts AS time, 'feed' AS source, 'breaking_news' AS event_type, j->>'title' AS title, coalesce(j->>'description', '') AS content FROM r WHERE j->>'title' <> ''")
def feed_records(spark, sf_dir):
    received = _records(spark, sf_dir, FEED).join(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return N.feed_events(received, "record", "ts").drop("ts")


@query(
    "sequence_draw",
    f"""WITH {SEGMENTS}, s AS (SELECT instrument, segment, count(*) AS n, min(idx) AS first_idx FROM seg GROUP BY 1, 2 HAVING count(*) >= 4), o AS (SELECT instrument, segment, first_idx, unnest(range(0, n - 3)) AS "offset" FROM s)
    SELECT instrument, segment::BIGINT AS segment, "offset", first_idx + "offset" AS start_idx FROM o ORDER BY md5(instrument || ':' || (first_idx + "offset") || ':7'), 1, 4 LIMIT 20""",
)
def sequence_draw(spark, sf_dir):
    return V.draw_starts(V.segments(bars(spark, sf_dir), 7200), 4, 20, seed=7)


@query(
    "positional_join",
    f"""WITH {BARS}, later AS (SELECT instrument, time + INTERVAL '1 year' AS later, close + 1 AS later_close, row_number() OVER (PARTITION BY instrument ORDER BY time) - 1 AS idx FROM bars)
    SELECT instrument, idx, time, later, round(later_close - close, 6) AS moved FROM bars JOIN later USING (instrument, idx)""",
)
def positional_join(spark, sf_dir):
    """Two series of the same length, each numbered by its own times."""
    shifted = raw_bars(spark, sf_dir).withColumn("time", F.col("time") + F.expr("INTERVAL 1 YEAR"))
    later = with_index(shifted).select("instrument", "idx", F.col("time").alias("later"), (F.col("close") + 1).alias("later_close"))
    both = zip_strict(bars(spark, sf_dir).select("instrument", "idx", "time", "close"), later)
    return both.withColumn("moved", F.col("later_close") - F.col("close")).select("instrument", "idx", "time", "later", *rounded("moved"))


@query("sql_text", "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def sql_text(spark, sf_dir):
    text = "SELECT event_type, count(*) AS n, max(ts) AS latest FROM {events} WHERE ts >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY 1"
    return R.run_sql(spark, text, {"events": table(spark, sf_dir, "events")}, {"since": "2024-01-05"})


@query(
    "mode_topn",
    """WITH t AS (SELECT p_brand AS run, split_part(p_type, ' ', 1) AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS nth FROM part),
    c AS (SELECT run, value, count(*) AS n, min(nth) AS first FROM t WHERE nth <= 5 GROUP BY 1, 2)
    SELECT run, value FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC, first) = 1""",
)
def mode_topn(spark, sf_dir):
    """Parts as trials, the size is the score: the commonest kind of part among the best five of each brand."""
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), kind.alias("value"), "p_size", "p_partkey")
    return S.commonest_of_best(own, ["run"], "p_size", "p_partkey", 5)


@query(
    "news_lines",
    """WITH e AS (SELECT event_id % 10 = 3 AS broken, event_id, ts, event_type, props FROM events), w AS (SELECT unnest(['table', 'stream']) AS way)
    SELECT way, CASE WHEN NOT broken THEN event_id END AS id, CASE WHEN NOT broken THEN date_trunc('second', ts) END AS time, CASE WHEN NOT broken THEN event_type END AS currency, CASE WHEN NOT broken THEN props END AS content, broken FROM e, w""",
)
def news_lines(spark, sf_dir):
    """Events as lines of JSON, every tenth broken off, read by the data source as a table and as a stream."""
    path, own = scratch_path(spark, "news-lines"), table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_type").alias("currency"), F.col("props").alias("content")))
    lines = own.select(F.when(F.col("event_id") % 10 == 3, F.substring(record, 1, 20)).otherwise(record).alias("value"))
    lines.repartition(4).write.text(path)
    spark.dataSource.register(NewsLines)
    ways = {"table": spark.read.format("news_lines").option("path", path).load(), "stream": drained(spark.readStream.format("news_lines").option("path", path).load(), "news-read", key=None).rows}
    told = [
        df.select(F.lit(way).alias("way"), F.col("id").cast("long").alias("id"), F.col("time").cast("timestamp_ntz").alias("time"), "currency", "content", F.col("error").isNotNull().alias("broken"))
        for way, df in ways.items()
    ]
    return told[0].unionByName(told[1])


PRICES = ("open", "high", "low", "close")


@query(
    "sequence_windows",
    f"""WITH {SEGMENTS}, s AS (SELECT instrument, segment, count(*) AS n, min(idx) AS first_idx FROM seg GROUP BY 1, 2 HAVING count(*) >= 4),
    o AS (SELECT instrument, segment, first_idx + unnest(range(0, n - 3, 2)) AS start_idx FROM s),
    r AS (SELECT o.*, b.idx, unnest([{', '.join(f'b.{c}' for c in PRICES)}]) AS value, unnest(range(4)) AS k FROM o JOIN bars b ON b.instrument = o.instrument AND b.idx BETWEEN start_idx AND start_idx + 3)
    SELECT instrument, segment::BIGINT AS segment, start_idx, ((idx - start_idx) * 4 + k)::INT AS place, round(value, 6) AS value FROM r""",
)
def sequence_windows(spark, sf_dir):
    """The prices of every second window of four bars, by the table function in SQL."""
    table_functions.register(spark)
    rows = V.segments(bars(spark, sf_dir), 7200).select("instrument", "segment", "idx", *PRICES)
    text = "SELECT * FROM sequences(rows => TABLE(SELECT * FROM {rows}) PARTITION BY (instrument, segment) ORDER BY (idx), length => 4, stride => 2)"
    found = spark.sql(text, rows=rows)
    return found.select("instrument", "segment", "start_idx", F.posexplode("features").alias("place", "value")).withColumn("value", F.round("value", 6))
