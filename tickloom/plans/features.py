"""Queries: the registry of feature sets, its parameters and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.quotes import Quotes
from tickloom.operators.registry import standard
from tickloom.plans.base import BARS, TICKS, bars, bars_sql, query, raw_bars, ticks
from tickloom.plans.patterns import STREAK, W, frame
from tickloom.plans.simulation import ICT, TOLERANCE, _ict_sql
from tickloom.sources.scratch import stored

TUNABLES = """(VALUES ('ict__lookback', 20, 5, 50), ('ict__level_max_age', 100, 20, 300), ('scalp__roc_fast', 5, 2, 15), ('scalp__roc_slow', 20, 10, 60),
    ('scalp__mean_rev_period', 30, 10, 100), ('scalp__atr_period', 14, 5, 50), ('tick__spread_avg_period', 30, 10, 100)) v(name, d, lo, hi)"""
#: Two parameters away from their defaults, and one that no set knows.
TUNED = {"scalp__roc_fast": 3.0, "scalp__roc_slow": 12, "nobody__n": 1}


@query(
    "feature_tunables",
    f"""WITH {BARS}, n AS (SELECT instrument, count(*) AS n_bars FROM bars GROUP BY 1)
    SELECT instrument, name, d::DOUBLE AS "default", lo::DOUBLE AS low, least(hi, n_bars)::DOUBLE AS high, 'int' AS kind, n_bars >= d AS usable FROM n, {TUNABLES}""",
)
def feature_tunables(spark, sf_dir):
    """The tunables of each instrument: no range reaches beyond the bars that it has."""
    counts = raw_bars(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n_bars"))
    tunable = F.explode(standard().tunables_column()).alias("t")
    own = counts.select("instrument", "n_bars", tunable).select("instrument", "n_bars", "t.*")
    return own.select("instrument", "name", "default", "low", F.least("high", F.col("n_bars").cast("double")).alias("high"), "kind", (F.col("n_bars") >= F.col("default")).alias("usable"))


@query(
    "feature_registry",
    f"""WITH {BARS}, px AS (SELECT instrument, time, close AS price FROM bars), small AS {_ict_sql('1 hour')},
    rest AS (SELECT instrument, time, round(CASE WHEN idx >= 3 THEN close / lag(close, 2) OVER {W} - 1 END, 6) AS scalp__roc_fast, round(CASE WHEN idx >= 12 THEN close / lag(close, 11) OVER {W} - 1 END, 6) AS scalp__roc_slow,
      round(CASE WHEN idx >= 29 THEN coalesce((close - avg(close) OVER {frame(30)}) / nullif(stddev_pop(close) OVER {frame(30)}, 0), 0) END, 6) AS scalp__mean_rev_z,
      round(CASE WHEN idx >= 13 THEN avg(high - low) OVER {frame(14)} END, 6) AS scalp__atr,
      round(CASE WHEN idx >= 13 THEN coalesce(sum(abs(close - open)) OVER {frame(14)} / nullif(sum(high - low) OVER {frame(14)}, 0), 0) END, 6) AS scalp__body_ratio,
      round(spread, 6) AS tick__spread, round(CASE WHEN idx >= 1 THEN coalesce((spread - avg(spread) OVER {frame(30)}) / nullif(round(stddev_pop(spread) OVER {frame(30)}, 9), 0), 0) ELSE 0 END, 6) AS tick__spread_z,
      round(high - low, 6) AS tick__bar_range, round(CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END, 6) AS tick__position FROM bars)
    SELECT rest.*, {", ".join(f"round(small.{c}, 6) AS ict__{c}" for c in ICT)} FROM rest JOIN small USING (instrument, time)""",
)
def feature_registry(spark, sf_dir):
    found = standard(TOLERANCE).features(stored(bars(spark, sf_dir), "bars"), TUNED)
    return found.select("instrument", "time", *[F.round(c, 6).alias(c) for c in found.columns if "__" in c])


def _of_count(n: int, name: str = "bars") -> str:
    """CTEs of hourly bars and of the bars that every n of them make."""
    return f"""{bars_sql('base', '1 hour')}, {name} AS (SELECT instrument, idx // {n} AS idx, min(time) AS time, first(open ORDER BY idx) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY idx) AS close
      FROM base GROUP BY instrument, idx // {n} HAVING count(*) = {n})"""


def _scalp_sql(n: int) -> str:
    return f"""(WITH {_of_count(n)}, {STREAK}, s AS (SELECT *, dir * least(row_number() OVER (PARTITION BY instrument, run ORDER BY idx), 31) AS streak FROM runs)
      SELECT instrument, idx, CASE WHEN idx >= 3 THEN close / lag(close, 2) OVER {W} - 1 END AS roc_fast, CASE WHEN idx >= 12 THEN close / lag(close, 11) OVER {W} - 1 END AS roc_slow,
        CASE WHEN idx >= 29 THEN avg(close) OVER {frame(30)} END AS mean, round(stddev_pop(close) OVER {frame(30)}, 9) AS deviation, CASE WHEN idx >= 13 THEN avg(high - low) OVER {frame(14)} END AS atr,
        CASE WHEN idx >= 13 THEN coalesce(sum(abs(close - open)) OVER {frame(14)} / nullif(sum(high - low) OVER {frame(14)}, 0), 0) END AS body_ratio, streak FROM s)"""


def _scalp_columns(n: int) -> str:
    own = {
        "roc_fast": "roc_fast",
        "roc_slow": "roc_slow",
        "mean_rev_z": "(q.mid - {t}.mean) / nullif({t}.deviation, 0)",
        "atr": "atr",
        "body_ratio": "body_ratio",
        "range_ratio": "(q.so_high - q.so_low) / nullif({t}.atr, 0)" if n == 1 else "0",
        "direction_streak": "streak",
    }
    return ", ".join(f"round(coalesce({v.format(t=f's{n}') if '.' in v or v == '0' else f's{n}.{v}'}, 0), 6)::DOUBLE AS scalp__x{n}_{c}" for c, v in own.items())


def _level_sql(n: int) -> str:
    return _ict_sql("", _of_count(n), f"px p LEFT JOIN st ON st.instrument = p.instrument AND st.idx = p.closed // {n} - 1")


SCALP_WIDTHS, LEVEL_WIDTHS = (1, 4), (4, 12)


@query(
    "quote_features",
    f"""WITH {TICKS}, {bars_sql('base', '1 hour')}, q AS (SELECT t.instrument, t.seq, t.time, t.mid, t.ask - t.bid AS spread, b.idx AS closed, epoch(t.time - b.time) AS passed, max(t.mid) OVER p AS so_high, min(t.mid) OVER p AS so_low, count(*) OVER p AS so_many
      FROM ticks t JOIN base b ON b.instrument = t.instrument AND b.time = time_bucket(INTERVAL '1 hour', t.time) WINDOW p AS (PARTITION BY t.instrument, b.time ORDER BY t.time, t.seq ROWS UNBOUNDED PRECEDING)),
    px AS (SELECT instrument, seq AS time, mid AS price, closed FROM q), spreads AS (SELECT instrument, idx, CASE WHEN idx >= 1 THEN avg(spread) OVER {frame(30)} END AS mean, round(stddev_pop(spread) OVER {frame(30)}, 9) AS deviation FROM base),
    {", ".join(f"s{n} AS {_scalp_sql(n)}" for n in SCALP_WIDTHS)}, {", ".join(f"l{n} AS {_level_sql(n)}" for n in LEVEL_WIDTHS)}
    SELECT q.instrument, q.seq, round(q.spread, 6) AS tick__spread, round(coalesce((q.spread - sp.mean) / nullif(sp.deviation, 0), 0), 6) AS tick__spread_z, round(so_high - so_low, 6) AS tick__partial_range,
      round(CASE WHEN so_high > so_low THEN (q.mid - so_low) / (so_high - so_low) ELSE 0.5 END, 6) AS tick__position_in_range, round(least(passed / 3600, 1.0::DOUBLE), 6) AS tick__elapsed_pct, so_many::DOUBLE AS tick__tick_count, round(q.mid, 6) AS tick__mid,
      {", ".join(_scalp_columns(n) for n in SCALP_WIDTHS)}, {", ".join(f"round(l{n}.{c}, 6) AS ict__x{n}_{c}" for n in LEVEL_WIDTHS for c in ICT)},
      (hour(q.time) < 4 OR hour(q.time) BETWEEN 7 AND 9 OR hour(q.time) BETWEEN 12 AND 15)::INT::DOUBLE AS ict__killzone
    FROM q LEFT JOIN spreads sp ON sp.instrument = q.instrument AND sp.idx = q.closed - 1 {" ".join(f"LEFT JOIN s{n} ON s{n}.instrument = q.instrument AND s{n}.idx = q.closed // {n} - 1" for n in SCALP_WIDTHS)}
    {" ".join(f"JOIN l{n} ON l{n}.instrument = q.instrument AND l{n}.time = q.seq" for n in LEVEL_WIDTHS)}""",
)
def quote_features(spark, sf_dir):
    """All 42 features at each quote: hourly bars, and wider ones of 4 and 12 of them."""
    own = Quotes.over(ticks(spark, sf_dir), 3600, tuple({*SCALP_WIDTHS, *LEVEL_WIDTHS}))
    found = standard(TOLERANCE, SCALP_WIDTHS, LEVEL_WIDTHS).quote_features(own, TUNED)
    return found.select("instrument", "seq", *[F.round(c, 6).alias(c) for c in found.columns if "__" in c])
