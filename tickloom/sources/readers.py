"""Files of candles and quotes in their usual layouts, and their sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The headers under which each column goes, first match wins.
TIME_NAMES = ("time", "date", "datetime", "timestamp")
PRICE_NAMES = {"open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c")}
VOLUME_NAMES = ("volume", "vol", "v", "tickqty")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "MM/dd/yyyy HH:mm:ss.SSS", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd")


def _headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _named(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    return next((F.col(n) for n in names if n in df.columns), None)


def moment(text: Column) -> Column:
    """A time in any of the known formats, without a zone; null if in none."""
    clean = F.regexp_replace(F.trim(text), r"(\.[0-9]+)?(Z|[+-]00:?00)$", "")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


#: Headers of at most this many files are broadcast, of some hundred bytes each.
FEW_FILES = 20_000


def by_header(spark: SparkSession, path: str, wanted: dict[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> DataFrame:
    """``file`` and the ``wanted`` columns as text, each file read by its own header: files of a folder may name and order theirs as they like.

    A column goes under the first of its names that a header has, without regard to case and spaces. A file whose header
    lacks a column that is not ``optional`` is an error that names both. Fields stand on one line; lines equal to the
    header are left out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    first = lines.where("begin = 0").withColumn("nth", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "nth").alias("header"))
    names = F.transform(F.split("header", ","), lambda n: F.lower(F.trim(F.replace(n, F.lit('"'), F.lit("")))))

    def place(aliases: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(F.array_position("names", a), F.lit(0).cast("long")) for a in aliases])

    found = first.withColumn("names", names).select("file", "header", F.size("names").alias("width"), *[place(aliases).alias(n) for n, aliases in wanted.items()])
    needed = [n for n in wanted if n not in optional]
    lacking = found.where(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in needed])).select("file", *needed).limit(1).collect()
    if lacking:
        raise ValueError(f"{lacking[0]['file']}: no column for {', '.join(n for n in needed if lacking[0][n] is None)}")
    files, width = found.agg(F.count("*"), F.max("width")).first()
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width or 1)))
    headers = (F.broadcast(found) if files <= FEW_FILES else found).drop("width").withColumnsRenamed({n: f"_{n}" for n in wanted})
    split = lines.join(headers, "file").where("value <> header").withColumn("fields", _texts(fields, width or 1))
    return split.select("file", *[F.get("fields", F.col(f"_{n}").cast("int") - 1).alias(n) for n in wanted])


def _texts(fields: Column, width: int) -> Column:
    return F.array(*[F.trim(fields[f"c{i}"]) for i in range(width)])


_CANDLE = {"time": TIME_NAMES, **PRICE_NAMES}


def candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candles of CSV files with headers; a missing time or price column is an error, a missing volume is 0."""
    df = by_header(spark, path, {**_CANDLE, "volume": VOLUME_NAMES}, ("volume",))
    return df.select(moment(F.col("time")).alias("time"), *[F.col(n).try_cast("double").alias(n) for n in PRICE_NAMES], F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)).alias("volume"))


def bid_candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candles of files with bid and ask prices: the bid side, quote counts as volume; plain candles if there is no bid side."""
    df = _headers(spark.read.option("header", True).csv(path))
    if "bidopen" not in df.columns:
        return candles_csv(spark, path)
    prices = [F.col(f"bid{n}").try_cast("double").alias(n) for n in PRICE_NAMES]
    return df.select(moment(F.col("datetime")).alias("time"), *prices, F.coalesce(F.col("tickqty").try_cast("double"), F.lit(0.0)).alias("volume"))


def terminal_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candles of trading-terminal exports: date and time in two columns, volume from the first volume column there is."""
    df = _headers(spark.read.option("header", True).csv(path))
    volume = _named(df, ("tickvol", "vol", "volume"))
    return df.select(
        moment(F.concat_ws(" ", "date", "time")).alias("time"),
        *[F.col(n).try_cast("double").alias(n) for n in PRICE_NAMES],
        (F.lit(0.0) if volume is None else F.coalesce(volume.try_cast("double"), F.lit(0.0))).alias("volume"),
    )


def directory_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Candles of all CSV files of a folder; the file's stem is the instrument, renamed by ``names``.

    Where Spark wrote the files, their stem is that of the folder around them, without ``column=``.
    """
    df = by_header(spark, path, _CANDLE)
    file = F.regexp_replace("file", r"/part-[^/]*$", "")
    own = F.upper(F.regexp_extract(file, r"([^/=]+?)(?:\.csv)?(?:\.gz)?$", 1))
    known = F.create_map(*[F.lit(x) for pair in (names or {}).items() for x in pair]) if names else None
    instrument = F.coalesce(F.try_element_at(known, own), own) if names else own
    return df.select(instrument.alias("instrument"), moment(F.col("time")).alias("time"), *[F.col(n).try_cast("double").alias(n) for n in PRICE_NAMES])


def quotes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quotes with epoch milliseconds; rows that do not parse are left out."""
    df = _headers(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))
    millis, bid, ask = F.col("timestamp").try_cast("long"), F.col("bidprice").try_cast("double"), F.col("askprice").try_cast("double")
    good = df.where(millis.isNotNull() & bid.isNotNull() & ask.isNotNull())
    return good.select(F.timestamp_millis(millis).cast("timestamp_ntz").alias("time"), bid.alias("bid"), ask.alias("ask"))


def candles_dir(spark: SparkSession, path: str) -> DataFrame:
    """Parquet candles of a folder, quote counts as long."""
    df = spark.read.parquet(path)
    return df.withColumn("tick_count", F.col("tick_count").try_cast("long")) if "tick_count" in df.columns else df


def write_months(df: DataFrame, path: str) -> None:
    """Parquet by instrument and month; months present in ``df`` replace what is there."""
    dated = df.withColumn("month", F.date_format("time", "yyyy-MM"))
    dealt = dated.repartition("instrument", "month").sortWithinPartitions("instrument", "time")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "month").parquet(path)


def valid_candles(df: DataFrame) -> DataFrame:
    """Rows whose high and low bound open and close."""
    rules = [F.col("high") >= F.col("low"), F.col("high") >= F.greatest("open", "close"), F.col("low") <= F.least("open", "close")]
    return df.where(reduce(lambda a, b: a & b, rules))


PARAMS = "part string, name string, value double, low double, high double"


def write_params(params: DataFrame, path: str) -> None:
    """Named parameters by part, each with its value and range, as one JSON line each."""
    params.select(*[c.split()[0] for c in PARAMS.split(", ")]).write.mode("overwrite").partitionBy("part").json(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of a file; those without a range have null bounds."""
    return spark.read.schema(PARAMS).json(path)


#: A log has at most this many parameters, as each is a column.
MOST_PARAMS = 2_000


def write_trial_log(trials: DataFrame, params: DataFrame, keys: list[str], path: str) -> None:
    """Trials as CSV, one line each, with every parameter (keys, part, name, value) in a column ``part__name``.

    Parameters that a trial does not have are empty; of two values of one parameter the least is written. More than
    ``MOST_PARAMS`` parameters are an error.
    """
    named = params.withColumn("column", F.concat_ws("__", "part", "name"))
    names = sorted(r["column"] for r in named.select("column").distinct().limit(MOST_PARAMS + 1).collect())
    if len(names) > MOST_PARAMS:
        raise ValueError(f"more than {MOST_PARAMS} parameters")
    wide = named.groupBy(*keys).agg(*[F.min(F.when(F.col("column") == n, F.col("value"))).alias(n) for n in names])
    trials.join(wide, keys, "left").write.mode("overwrite").option("header", True).csv(path)


def read_trial_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A trial log: its own ``columns`` as given, every column with two underscores as a number, by the header."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    kinds = dict(c.split() for c in columns.split(", "))
    return df.select(*[F.col(c).try_cast(kinds.get(c, "double")).alias(c) for c in df.columns if c in kinds or "__" in c])


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], values: dict | None = None) -> DataFrame:
    """A SQL text over frames, named in it as ``{name}``, with values as ``:name``; values are never part of the text."""
    return spark.sql(text, args=values or {}, **tables)
