"""What the corpus operators share: reading tables, intermediate tables in the shared folder, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none (tests)."""
    place = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not place:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the whole cluster shares")
        place = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set(CHECKPOINT_CONF, place)
    return place.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder name in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tickloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: The folders made in the innermost ``temporary`` of this thread; two runs at once do not see each other's.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def materialise(df: DataFrame, label: str, *, keep: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that survives lost executors.

    Within ``temporary``, the folder goes when that ends, unless ``keep``. Each value of the columns ``by`` has a folder
    of its own.
    """
    spark = df.sparkSession
    path, made = new_path(spark, label), _made.get()
    if made is not None and not keep:
        made.append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables materialised in it."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield
    finally:
        _made.reset(outer)
        for folder in made:
            _delete(spark, folder)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A materialised table marked for broadcast where its counted rows are at most ``rows``; unmarked otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


#: A key is hot from 1 / HOT_KEYS of the rows on (and from LEAST_HOT rows on), so there are at most HOT_KEYS hot keys.
HOT_KEYS, LEAST_HOT = 1000, 256
_SALT, _SALTS = "__salt", "__salts"


def split_join(left: DataFrame, right: DataFrame, key: str, spread: str | Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Equi-join on ``key`` in which rows of ``left`` with a hot key are dealt over as many salts as their count asks for.

    ``counts`` (key, n) says how many rows of ``left`` each key has; without it ``left`` is counted first, so it should
    be a table on disk. ``spread`` tells the rows of ``left`` apart. The hot keys, at most ``HOT_KEYS`` whatever the
    data, are broadcast to both sides; rows of ``right`` with a hot key are repeated once for each of its salts.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("n"))
    least = max(LEAST_HOT, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    many = counts.where((F.col("n") > least) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / least).cast("int"))
    hot = [(r[0], r[1]) for r in many.collect()]
    if not hot:
        return left.join(right, key, how)
    salts = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(key, F.lit(1).alias(_SALTS)).schema))
    own = F.coalesce(F.col(_SALTS), F.lit(1))
    dealt = left.join(salts, key, "left").withColumn(_SALT, F.pmod(F.xxhash64(spread), own).cast("int")).drop(_SALTS)
    repeated = right.join(salts, key, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), own - 1))).drop(_SALTS)
    return dealt.join(repeated, [key, _SALT], how).drop(_SALT)


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def batches_of_documents(spark: SparkSession) -> None:
    """Hand texts to Python workers 1,000 at a time, where the session has not chosen a number itself.

    Spark's own 10,000 suits rows of numbers; as many documents, with their copies in Arrow and pandas, take hundreds of
    megabytes in each worker.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand at most ``rows`` rows at a time to the Python workers of jobs that run in it, where the rows are large."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def fold(doc_id: Column) -> Column:
    """The hold-out fold of a document, 0 to 3; fold 2 is never learned from, and a null id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(2))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
