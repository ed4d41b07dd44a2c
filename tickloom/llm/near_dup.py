"""Similarity join of whole texts on Jaccard similarity of word n-grams.

MinHash banding proposes candidates: band and row counts are chosen for a target recall at the
threshold, and texts are shuffled on their band hashes. Candidates are gathered into clusters (connected
components of shared buckets). A small cluster is one unit of work; a large one is dealt into chunks of
bounded size, texts of one neighbourhood together. The n-grams of a chunk are packed into one row, and each
chunk meets the others that share a bucket with it one after the other, so chunks of which no pair is proposed
are never compared. Pairs of distinct texts are verified on full n-gram sets. What leaves are the links of each
text counted once within its chunk and once over all others, and a spanning forest, never the pairs: rows grow
with the texts of a group and the pairs of its chunks, only the comparisons with the square of the texts. Exact copies are one text throughout and
come back by their content hash at the end, through a join that deals a hot text over salts.

Words are the lower-cased white-space runs of a text; a text of fewer than five words is one n-gram.

Defined cases: null counts as the empty text; texts without words link to nothing, but equal texts are
one class; repeated rows are copies; null ids never name a class that has a real id; where ids repeat
for different texts, two classes may share a ``class_id`` and ``class_key`` tells them apart; very long
texts are read whole; a pair at the very threshold links (ties count); other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, discard, materialise, split_join, text_or_empty
from tickloom.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
HASHES = 128
#: n-grams in one chunk of a cluster on average, and what a text weighs at least: memory of a unit of work.
CHUNK_GRAMS, LEAST_WEIGHT = 400_000, 600
MEMO_ENTRIES = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    """Hashes of the words seen; bounded, and refilled when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_known = _Known()


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which some number of bands within ``hashes`` reaches the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


def grams(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word n-grams of a whole text, ascending."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(_known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(codes) - words + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(codes))):
        rolled = (rolled ^ codes[k : k + n]) * _MIX
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


@lru_cache(maxsize=2)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    draw = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def band_hashes(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of a set of n-grams."""
    a, b = _functions(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):  # small enough to stay in cache
        some = found[at : at + 512]
        np.minimum(least, (a[:, None] * some[None, :] + b[:, None]).min(axis=1), out=least)
    out = np.zeros(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(31)
    return out


def _sketcher(bands: int, rows: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [grams(t) for t in batch.pop("text")]
            batch["n"] = [len(s) for s in sets]
            batch["bands"] = [band_hashes(s, bands, rows).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64) for s in sets]
            yield batch

    return sketch


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def linked(sets: list[np.ndarray], threshold: float, chunk: np.ndarray, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place with the places of the texts it is linked to; ``across``: only to those of another chunk.

    Shared n-grams are counted by matrix products over slices of the n-grams that two texts or more have.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(int))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), dtype=np.float32)
    width = 2048
    ends = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k in range(len(ends) - 1):
        own, col = owner[ends[k] : ends[k + 1]], column[ends[k] : ends[k + 1]] - k * width
        rows = np.unique(own)
        dense = np.zeros((len(rows), width), dtype=np.float32)
        dense[np.searchsorted(rows, own), col] = 1
        common[np.ix_(rows, rows)] += dense @ dense.T
    for i in range(m):
        union = sizes[i] + sizes - common[i]
        near = common[i] >= threshold * union - 1e-9
        near[i] = False
        if across:
            near &= chunk != chunk[i]
        yield i, np.flatnonzero(near)


def _verify_unit(uids: list[int], sets: list[np.ndarray], chunks: list[int], threshold: float, across: bool) -> pd.DataFrame:
    """Links and roots of a unit's texts; ``across``: its two chunks differ, so links inside one are counted in another unit."""
    parent = list(range(len(uids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = np.zeros(len(uids), dtype=np.int64)
    chunk = np.array(chunks)
    for i, near in linked(sets, threshold, chunk, across):
        links[i] = len(near)
        for j in near[near > i]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"uid": uids, "links": links, "root": [uids[root(i)] for i in range(len(uids))]})


def _verifier(threshold: float):
    """Streams rows sorted by unit of work (cluster, low, high) and uid; one unit is in memory at a time."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, uids, sets, chunks, ready, held = None, [], [], [], [], 0
        for batch in batches:
            for cluster, low, high, uid, chunk, text in zip(*(batch[c].tolist() for c in ("cluster", "low", "high", "uid", "chunk", "text"))):
                if (cluster, low, high) != unit:
                    if len(uids) > 1:
                        ready.append(_verify_unit(uids, sets, chunks, threshold, unit[1] != unit[2]))
                        held += len(uids)
                    unit, uids, sets, chunks = (cluster, low, high), [], [], []
                if not uids or uids[-1] != uid:
                    uids.append(uid)
                    sets.append(grams(text))
                    chunks.append(chunk)
            if held > 5000:
                yield pd.concat(ready)
                ready, held = [], 0
        if len(uids) > 1:
            ready.append(_verify_unit(uids, sets, chunks, threshold, unit[1] != unit[2]))
        if ready:
            yield pd.concat(ready)

    return verify


PACK = "chunk long, uids array<long>, links array<long>, roots array<long>, sizes array<int>, grams binary"


def _packed(chunk: int, uids: list[int], sets: list[np.ndarray], threshold: float) -> pd.DataFrame:
    """One row of a chunk: its texts with the links among them, and their n-grams one after the other."""
    own = _verify_unit(uids, sets, [0] * len(uids), threshold, False)
    row = {"chunk": chunk, "uids": uids, "links": own["links"].tolist(), "roots": own["root"].tolist(), "sizes": [len(s) for s in sets], "grams": np.concatenate(sets).tobytes()}
    return pd.DataFrame([row])


def _packer(threshold: float):
    """Streams texts sorted by chunk and uid into one row for each chunk."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, uids, sets = None, [], []
        for batch in batches:
            for chunk, uid, text in zip(batch["chunk"].tolist(), batch["uid"].tolist(), batch["text"].tolist()):
                if chunk != held:
                    if uids:
                        yield _packed(held, uids, sets, threshold)
                    held, uids, sets = chunk, [], []
                if not uids or uids[-1] != uid:
                    uids.append(uid)
                    sets.append(grams(text))
        if uids:
            yield _packed(held, uids, sets, threshold)

    return pack


class _Chunk:
    """A chunk unpacked: n-grams ascending, with the place of the text that each is of."""

    def __init__(self, row: dict):
        self.uids, self.roots = np.asarray(row["uids"]), np.asarray(row["roots"])
        self.sizes = np.asarray(row["sizes"]).astype(np.float64)
        found = np.frombuffer(row["grams"], dtype=np.uint64)
        order = np.argsort(found, kind="stable")
        self.grams, self.owner = found[order], np.repeat(np.arange(len(self.uids)), row["sizes"])[order]

    def within(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and places in ``known`` of the n-grams that are there, in order of place."""
        at = np.minimum(np.searchsorted(known, self.grams), len(known) - 1)
        there = known[at] == self.grams
        return self.owner[there], at[there]


def links_across(one: _Chunk, two: _Chunk, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place in ``one`` with the places of the texts of ``two`` it is linked to, if any; shared n-grams as in ``linked``."""
    known, width = np.intersect1d(one.grams, two.grams), 2048
    if not len(known):
        return
    common = np.zeros((len(one.uids), len(two.uids)), dtype=np.float32)
    sides = [(own, at, np.searchsorted(at, np.arange(0, len(known) + width, width))) for own, at in (one.within(known), two.within(known))]
    for k in range(-(-len(known) // width)):
        dense = []
        for own, at, ends in sides:
            some, column = own[ends[k] : ends[k + 1]], at[ends[k] : ends[k + 1]] - k * width
            rows = np.unique(some)
            cells = np.zeros((len(rows), width), dtype=np.float32)
            cells[np.searchsorted(rows, some), column] = 1
            dense.append((rows, cells))
        (left, a), (right, b) = dense
        common[np.ix_(left, right)] += a @ b.T
    for i in range(len(one.uids)):
        near = np.flatnonzero(common[i] >= threshold * (one.sizes[i] + two.sizes - common[i]) - 1e-9)
        if len(near):
            yield i, near


#: Groups of texts whose connections a task remembers; beyond them it forgets, and may name a connection twice.
MOST_KNOWN = 200_000


def _across(threshold: float):
    """Streams rows sorted by home, side and chunk, the home chunk before those it meets; two chunks are in memory at a time.

    Gives each text of the home with a link its links to other chunks, and connections (links 0) of groups that are
    whole within their chunks, each once.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home, links, edges, parent = None, None, [], {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def told() -> pd.DataFrame:
            some = np.flatnonzero(links)
            ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
            uids = np.concatenate([home.uids[some], ends[:, 0]])
            return pd.DataFrame({"uid": uids, "links": np.concatenate([links[some], np.zeros(len(ends), dtype=np.int64)]), "root": np.concatenate([home.uids[some], ends[:, 1]])})

        for batch in batches:
            for row in batch.to_dict("records"):
                if row["side"] == 0:
                    if home is not None:
                        yield told()
                    home, edges, parent = _Chunk(row), [], {}
                    links = np.zeros(len(home.uids), dtype=np.int64)
                    continue
                other = _Chunk(row)
                if len(parent) > MOST_KNOWN:
                    parent.clear()
                for i, near in links_across(home, other, threshold):
                    links[i] += len(near)
                    for far in np.unique(other.roots[near]).tolist():
                        a, b = root(int(home.roots[i])), root(far)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            edges.append((max(a, b), min(a, b)))
        if home is not None:
            yield told()

    return meet


def _members(texts: DataFrame) -> DataFrame:
    """(bucket, uid) of every text."""
    return texts.select("uid", F.posexplode("bands").alias("band", "value")).select("uid", F.xxhash64("band", "value").alias("bucket"))


def _bucket_edges(texts: DataFrame) -> DataFrame:
    """Star edges (a, b) with their bucket: each text to the smallest text in each bucket of two or more."""
    members = _members(texts)
    sized = members.groupBy("bucket").agg(F.min("uid").alias("b"), F.max("uid").alias("top"), F.count("*").alias("n"))
    stars = materialise(sized.where("b < top").select("bucket", "b", "n"), "buckets")
    met = split_join(members, stars.select("bucket", "b"), "bucket", "uid", counts=stars.select("bucket", "n"))
    return met.select(F.col("uid").alias("a"), "b", "bucket")


def _units(clusters: DataFrame, texts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Texts of small clusters, texts of large ones with their chunk, the chunks that meet (both ways), and the tables behind them."""
    sized = texts.select("uid", "rep", "key", F.greatest("n", F.lit(LEAST_WEIGHT)).alias("weight"))
    weighed = materialise(clusters.join(sized, "uid"), "weighed")
    crowded = weighed.groupBy("cluster").agg(F.sum("weight").alias("total")).where(F.col("total") > CHUNK_GRAMS).select("cluster")
    one = split_join(weighed, crowded, "cluster", "uid", "left_anti")
    one = one.select("uid", "rep", "key", "cluster", *[F.lit(0).cast("long").alias(c) for c in ("chunk", "low", "high")])
    homes = edges.groupBy(F.col("a").alias("uid")).agg(F.min("b").alias("home"))
    homed = materialise(split_join(weighed, crowded, "cluster", "uid", "left_semi").join(homes, "uid"), "homed")
    crowd = homed.groupBy("home").agg(F.ceil(F.sum("weight") / CHUNK_GRAMS).alias("parts"))
    dealt = split_join(homed, crowd, "home", "uid").withColumn("chunk", F.xxhash64("home", F.pmod(F.xxhash64("uid"), F.col("parts"))))
    chunked = materialise(dealt.select("uid", "rep", "key", "cluster", "chunk"), "chunked")
    present = edges.select(F.col("a").alias("uid"), "bucket").join(chunked.select("uid", "chunk"), "uid").select("bucket", "chunk").distinct()
    present = materialise(present, "present")
    other = present.select("bucket", F.col("chunk").alias("home"))
    met = materialise(split_join(present, other, "bucket", "chunk").where("chunk <> home").select("home", "chunk").distinct(), "met")
    return one, chunked, met, [weighed, homed, chunked, present, met]


def _verified(keyed: DataFrame, one: DataFrame, chunked: DataFrame, met: DataFrame, threshold: float) -> list[DataFrame]:
    """Links of texts and a spanning forest, (uid, links, root), in tables on disk: of small clusters, within chunks, across chunks."""

    def with_text(units: DataFrame, *names: str) -> DataFrame:
        same = (keyed["key"] == units["key"]) & keyed["doc_id"].eqNullSafe(units["rep"])
        return units.join(keyed, same).select(*names, "text")

    work = with_text(one, "cluster", "low", "high", "uid", "chunk")
    streamed = work.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "uid")
    small_ones = materialise(streamed.mapInPandas(_verifier(threshold), LINKED), "verified")
    if chunked.isEmpty():
        return [small_ones]
    texts = with_text(chunked, "chunk", "uid").repartition("chunk").sortWithinPartitions("chunk", "uid")
    packs = materialise(texts.mapInPandas(_packer(threshold), PACK), "packs")
    inside = packs.select(F.explode(F.arrays_zip("uids", "links", "roots")).alias("t")).select(F.col("t.uids").alias("uid"), F.col("t.links").alias("links"), F.col("t.roots").alias("root"))
    own = packs.withColumns({"home": F.col("chunk"), "side": F.lit(0)})
    both = own.unionByName(packs.join(met, "chunk").withColumn("side", F.lit(1)))
    homes = both.drop("links").repartition("home").sortWithinPartitions("home", "side", "chunk")
    with batches_of(packs.sparkSession, PACKS_AT_ONCE):
        across = materialise(homes.mapInPandas(_across(threshold), LINKED), "across")
    within = materialise(inside, "within")
    discard(packs)
    return [small_ones, within, across]


LINKED = "uid long, links long, root long"
#: Packed chunks, of a few megabytes each, that go to a Python worker at once.
PACKS_AT_ONCE = 4


def _classes(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows' doc_id and text key, and each text's key with class_id and class_key (smallest id of its class and the key of a text under it), n_links, n_copies."""
    bands, rows = banding(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = source.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    sketched = materialise(keyed.mapInPandas(_sketcher(bands, rows), "doc_id long, key binary, n int, bands array<long>"), "sketches")
    once = sketched.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = materialise(once.withColumn("uid", F.monotonically_increasing_id()), "texts")
    edges = materialise(_bucket_edges(texts), "stars")
    labels = components(edges)
    one, chunked, met, behind = _units(labels.select(F.col("node").alias("uid"), F.col("root").alias("cluster")), texts, edges)
    parts = _verified(keyed, one, chunked, met, threshold)
    verified = reduce(DataFrame.unionByName, parts)
    discard(edges, labels, *behind)
    classes = components(verified.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("uid").agg(F.sum("links").alias("n_links"))
    named = texts.select("key", "uid", "rep", "copies").join(classes.select(F.col("node").alias("uid"), "root"), "uid", "left").join(links, "uid", "left")
    named = materialise(named.withColumn("root", F.coalesce("root", "uid")), "named")
    discard(texts, *parts, classes)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key"))
    names = named.groupBy("root").agg(first.alias("first")).select("root", F.col("first.rep").alias("class_id"), F.col("first.key").alias("class_key"))
    per_text = split_join(named, names, "root", "uid").select("key", "class_id", "class_key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    return sketched.select("doc_id", "key"), per_text


def near_groups(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id of its class), n_links (different texts it is linked to), n_copies (rows of its text), class_key.

    ``class_key`` (hexadecimal) names the class by a text of it, whatever the ids are.
    """
    rows, per_text = _classes(docs, threshold, recall)
    joined = split_join(rows, per_text, "key", "doc_id")
    return joined.select("doc_id", "class_id", "n_links", "n_copies", F.lower(F.hex("class_key")).alias("class_key"))


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents with one row of each class: that of its smallest id; columns stay as they are.

    A row is known by its text and its id together, as ids may be null or repeated: of three unrelated texts without
    an id all stay. Rows that share both are copies, and one of them stays.
    """
    _, per_text = _classes(docs, threshold, recall)
    kept = per_text.select(F.col("class_id").alias(KEPT_ID), F.col("class_key").alias(KEPT_KEY)).distinct()
    keyed = docs.withColumns({OWN_ID: F.col("doc_id").cast("long"), OWN_KEY: text_key(text_or_empty())})
    joined = keyed.join(kept, (keyed[OWN_KEY] == kept[KEPT_KEY]) & keyed[OWN_ID].eqNullSafe(kept[KEPT_ID]), "left_semi")
    return joined.dropDuplicates([OWN_ID, OWN_KEY]).drop(OWN_ID, OWN_KEY)


OWN_ID, OWN_KEY, KEPT_ID, KEPT_KEY = "__near_id", "__near_key", "__kept_id", "__kept_key"
