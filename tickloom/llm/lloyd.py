"""Lloyd's centroid clustering over vectors cut into blocks of columns, in exact integers.

A vector is stored as one row for each block of ``WIDTH`` columns, a folder for each block, so a task reads one block. A
round has two steps. Tasks add up, for the columns of their block, the squared differences to their slice of every
centroid; a sum by row adds the blocks, and the least sum names the cluster. Then the blocks meet the clusters of their
rows again, and every block sums its own slice of the new centroids. What passes through the driver is the centroids
alone: ``k`` times the number of columns, whatever the number of rows.

Defined cases: a row without a vector, with another number of components, or with a null or non-finite one takes no
part; rows that share a ``vec_id`` are vectors of their own, null ids included (hashed as an empty id); of equal hashes
the smaller vector starts first; with fewer than ``k`` rows every row starts a centroid; an empty table gives an empty
result; columns but ``vec_id`` and ``embedding`` are not read. A component beyond ``LARGEST`` raises an error, as its
squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, materialise, temporary

#: Columns in a block. A row sends one row of ``k`` partial distances for each of its blocks.
WIDTH = 32
#: 64 squares of differences of two integers of this size fit a long.
LARGEST = 2**27
SCALE = 256
ROW, BLOCK = "row_id", "block"


def kept_vectors(embeddings: DataFrame, dims: int) -> DataFrame:
    """row_id, vec_id and ``v``, the integers floor(256 x) of the ``dims`` components; written once, so that ids last."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = embeddings.where((F.size("embedding") == dims) & finite)
    scaled = F.transform("embedding", lambda x: F.floor(F.when(F.abs(x.cast("double")) * SCALE <= LARGEST, x.cast("double") * SCALE).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}")))))
    return materialise(whole.select(F.monotonically_increasing_id().alias(ROW), "vec_id", scaled.alias("v")), "vectors")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, in the order of their hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def column_blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """One row for each vector and block of columns, a folder for each block. A narrow last block is filled with zeros."""
    parts = [F.struct(F.lit(b).alias(BLOCK), *[(F.col("v")[b * WIDTH + j] if b * WIDTH + j < dims else F.lit(0).cast("long")).cast("int").alias(f"x{j}") for j in range(WIDTH)]) for b in range(-(-dims // WIDTH))]
    cut = vectors.select(ROW, "vec_id", F.explode(F.array(*parts)).alias("p")).select(ROW, "vec_id", "p.*")
    return materialise(cut, "column-blocks", by=[BLOCK])


def partial_distances(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``d0``, ``d1``, ...: what the columns of a block add to the squared distance of its row to each centroid."""
    k = len(centroids)
    padded = np.pad(centroids, ((0, 0), (0, -centroids.shape[1] % WIDTH)))
    slices = [padded[:, s : s + WIDTH] for s in range(0, padded.shape[1], WIDTH)]
    norms = [(s * s).sum(axis=1) for s in slices]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(BLOCK).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(WIDTH)], axis=1).astype(np.int64)
            found = np.empty((len(x), k), dtype=np.int64)
            for b in np.unique(number):
                own = number == b
                found[own] = (x[own] ** 2).sum(axis=1)[:, None] - 2 * (x[own] @ slices[b].T) + norms[b]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("vec_id"), *[pa.array(found[:, c]) for c in range(k)]], names=[ROW, "vec_id", *[f"d{c}" for c in range(k)]])

    kind = blocks.schema["vec_id"].dataType.simpleString()
    return blocks.mapInArrow(measure, f"{ROW} long, vec_id {kind}, " + ", ".join(f"d{c} long" for c in range(k)))


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row_id, vec_id, cluster and distance of every vector: blocks are added by row, and the least sum wins, the first of equals."""
    k = len(centroids)
    summed = partial_distances(blocks, centroids).groupBy(ROW, "vec_id").agg(*[F.sum(f"d{c}").alias(f"d{c}") for c in range(k)])
    sums = F.array(*[F.col(f"d{c}") for c in range(k)])
    nearest = F.array_min(sums)
    return summed.select(ROW, "vec_id", (F.array_position(sums, nearest) - 1).cast("int").alias("cluster"), nearest.alias("distance"))


def moved_centroids(blocks: DataFrame, assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of every cluster, each block its own columns; a cluster without vectors stays where it was."""
    met = blocks.drop("vec_id").join(assigned.select(ROW, "cluster"), ROW)
    sums = met.groupBy(BLOCK, "cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{j}").alias(f"x{j}") for j in range(WIDTH)])
    out = centroids.copy()
    for row in sums.collect():  # at most one row for each block and centroid
        first = row[BLOCK] * WIDTH
        own = out[row["cluster"], first : first + WIDTH]
        own[:] = [row[f"x{j}"] // row["n"] for j in range(len(own))]
    return out


def cluster_vectors(embeddings: DataFrame, *, k: int = 40, dims: int = 64, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of ``embeddings``."""
    spark = embeddings.sparkSession
    with temporary(spark):
        vectors = kept_vectors(embeddings.select("vec_id", "embedding"), dims)
        centroids = first_centroids(vectors, k, seed)
        if not len(centroids):
            centroids = np.zeros((1, dims), dtype=np.int64)
        blocks = column_blocks(vectors, dims)
        for _ in range(rounds):
            assigned = materialise(assign(blocks, centroids), "assigned")
            centroids = moved_centroids(blocks, assigned, centroids)
            discard(assigned)
        last = materialise(assign(blocks, centroids).drop(ROW), "clusters", keep=True)
    within = dict(last.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    known = [(c, within[c], sum(within.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist()) if c in within]
    named = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
