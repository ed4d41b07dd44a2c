"""Files of one folder, each read by its own header."""

import gzip

import pytest

from tickloom.sources.readers import candles_csv, directory_csv

FILES = {
    "eurusd.csv": "Time,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,4,0.5,2,10\n2024-01-01 01:00:00,2,5,1.5,3,20\n",
    "gbpusd.csv": "close,low,high,open,time\n2,0.5,4,1,2024-01-01 00:00:00\n",
    "usdjpy.csv": '﻿"Date" , extra,O,H,L,C,tickqty\n2024.01.01 00:00,x,1,4,0.5,2,\n2024.01.01 01:00,"a,b",1,4,0.5,broken,7\n',
    "empty.csv": "",
    "header_only.csv": "time,open,high,low,close\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    with gzip.open(tmp_path / "xauusd.csv.gz", "wt") as out:
        out.write("Close,Open,High,Low,Time\n2,1,4,0.5,2024-01-01 00:00:00\n")
    return tmp_path


def test_columns_in_any_order(spark, folder):
    rows = directory_csv(spark, str(folder), {"EURUSD": "EUR/USD"}).collect()
    assert sorted({r.instrument for r in rows}) == ["EUR/USD", "GBPUSD", "USDJPY", "XAUUSD"]
    first = [r for r in rows if r.time.hour == 0]
    assert len(rows) == 6 and {(r.open, r.high, r.low, r.close) for r in first} == {(1.0, 4.0, 0.5, 2.0)}
    assert [r.close for r in rows if r.instrument == "USDJPY" and r.time.hour == 1] == [None]


def test_volume_under_any_name(spark, folder):
    rows = candles_csv(spark, str(folder)).collect()
    assert sorted(r.volume for r in rows) == [0.0, 0.0, 0.0, 7.0, 10.0, 20.0]


def test_missing_column_is_named(spark, folder):
    (folder / "bad.csv").write_text("time,open,high,close\n2024-01-01,1,2,1\n")
    with pytest.raises(ValueError, match=r"bad\.csv: no column for low"):
        directory_csv(spark, str(folder))
