"""News lines read as a table, in small parts, and as a stream that is stopped and replayed."""

import json

from tickloom.sources.news_lines import NewsLines
from tickloom.streaming.live import drained

BAD = ["{", "[]", "3", '{"id": 1}', '{"id": 1, "time": "soon", "currency": "x"}', "\xff"]


def write(folder, name, numbers):
    lines = [json.dumps({"id": i, "time": f"2024-01-01T00:{i % 60:02d}:00", "currency": "EUR", "title": "ü" * (i % 7), "content": None}, ensure_ascii=i % 2 == 0) for i in numbers]
    (folder / name).write_text("\n".join([*lines, *BAD, "", "  "]) + ("\n" if numbers[0] % 2 else ""), encoding="utf-8")


def rows(df):
    return sorted((str(r.id), str(r.time), str(r.currency), str(r.title), r.error is None) for r in df.collect())


def test_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    spark.dataSource.register(NewsLines)
    write(folder, "a.json", list(range(100)))
    (folder / "_hidden").write_text("x")
    (folder / "b.json").write_text("")
    table = spark.read.format("news_lines").option("path", str(folder)).load()
    whole = rows(table)
    assert len(whole) == 100 + len(BAD) and sum(not r[4] for r in whole) == len(BAD)
    for size in (701, 3000):
        assert rows(spark.read.format("news_lines").option("path", folder.as_uri()).option("part_bytes", size).load()) == whole
    place = str(tmp_path / "run")
    stream = lambda: spark.readStream.format("news_lines").option("path", str(folder)).load()
    assert rows(drained(stream(), "news", key=None, place=place).rows) == whole
    write(folder, "c.json", list(range(101, 150)))
    got = drained(stream(), "news", key=None, place=place).rows
    assert rows(got) == rows(spark.read.format("news_lines").option("path", str(folder)).load())
    assert drained(stream(), "news", key=None, place=place).rows.count() == got.count() == 149 + 2 * len(BAD)
