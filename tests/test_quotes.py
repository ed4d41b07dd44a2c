"""Features of quotes against a plain walk over the quotes, and whatever the chunks are."""

from datetime import datetime, timedelta
from statistics import fmean

from tickloom.operators import quotes, registry
from tickloom.operators.quotes import Quotes

START = datetime(2024, 1, 1)
TICK = "instrument string, time timestamp_ntz, seq long, mid double, bid double, ask double"


def own_ticks(n=400):
    rows, at = [], START
    for i in range(n):
        at += timedelta(seconds=1 + (i * 37) % 11 + (40 if i % 60 == 0 else 0))
        mid = 100 + i / 20 + abs(i % 120 - 60) / 2 + ((i * 7919) % 31) / 10 - ((i * 31) % 17) / 10
        wide = 0.1 + (i % 5) / 20
        rows.append(("a", at, i, mid, mid - wide, mid + wide))
    return rows


def by_hand(rows, width, n_wide, fast):
    """partial range, count, elapsed share and the fast rate of change of wide bars at each quote."""
    out, closes, bars, wide, begin, now = {}, [], 0, [], None, []
    for _, at, seq, mid, _, _ in rows:
        bucket = int((at - START).total_seconds()) // width
        if bucket != begin and begin is not None:
            bars += 1
            closes.append(now[-1])
            if bars % n_wide == 0:
                wide.append(closes[-1])
            now = []
        begin = bucket
        now.append(mid)
        change = wide[-1] / wide[-fast] - 1 if len(wide) > fast else 0.0
        out[seq] = (max(now) - min(now), len(now), (at - START).total_seconds() % width / width, change)
    return out


def test_quotes(spark, monkeypatch):
    rows = own_ticks()
    df = spark.createDataFrame(rows, TICK)
    found = registry.standard(2.0, (1, 3), (2, 3))

    def run():
        return found.quote_features(Quotes.over(df, 20, (2, 3)), {"scalp__roc_fast": 4}).orderBy("seq").collect()

    got = run()
    assert len([c for c in got[0].asDict() if "__" in c]) == 42 and len(got) == len(rows)
    want = by_hand(rows, 20, 3, 4)
    for r in got:
        have = (r.tick__partial_range, r.tick__tick_count, r.tick__elapsed_pct, r.scalp__x3_roc_fast)
        assert all(abs(a - b) < 1e-9 for a, b in zip(have, want[r.seq])), (r.seq, have, want[r.seq])
    assert sum(r.tick__spread_z != 0 for r in got) > 300 and sum(r.scalp__x3_roc_fast != 0 for r in got) > 200
    assert fmean(r.ict__x2_fvg_distance > 0 for r in got) > 0.3 and {r.ict__x2_trend for r in got} == {0.0, 1.0}  # a rising wave breaks highs only
    plain = quotes.running
    monkeypatch.setattr(quotes, "running", lambda *a, **k: plain(*a, **k, rows=3))
    assert run() == got
