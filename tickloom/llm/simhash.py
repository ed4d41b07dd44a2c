"""SimHash near-duplicates: fingerprints of word shingles, linked where at most two of their 64 bits differ.

A fingerprint is cut into two segments of 23 bits and one of 18. If two fingerprints differ in at most two bits, the
pigeonhole principle leaves five ways in which the bits can fall, and each way has a key in which the differing bits
are forgiven or left out:

====== ================ ================ ================ =====================
key    segment A        segment B        segment C        bits that may differ
====== ================ ================ ================ =====================
0      codeword         codeword         exact            one in A, one in B
1      left out         exact            exact            two in A
2      exact            left out         exact            two in B
3      codeword         exact            left out         one in A, rest in C
4      exact            codeword         left out         one in B, rest in C
====== ================ ================ ================ =====================

Two bits in C leave A and B exact, which key 3 has as well. "Codeword" is the Golay code: a fingerprint is stored under
its nearest codeword and looked up under all within four bits, so words that differ in one bit always meet. Pairs that
meet are verified on their bits. Equal fingerprints are one from the start, so no key sees copies.

A key under which more than ``CROWDED`` different fingerprints are stored is not joined: its fingerprints look up all
2,080 fingerprints within two bits of themselves instead, by equality, so a fingerprint never costs more than that.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; rows with equal ids are rows of
their own; a null id never names a component that has another, and a component of null ids alone has a null
``component_id``; a bit set in exactly half of the hashes is 0; texts are read whole, hashes counted in pieces; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of_documents, materialise, split_join, temporary
from tickloom.llm.components import components
from tickloom.llm.golay import LENGTH, MOST_NEAR, near_codewords

SHINGLE, SEED, FAR = 3, 42, 2
#: Hashes whose bits are counted at once.
PIECE = 32_768
CROWDED = 2000
REST = 64 - 2 * LENGTH
#: Bits of a key below its number, and of a codeword's number.
KEY_BITS, CODE_BITS = 60, 12


def fingerprint(text: str | None) -> int:
    """64 bits, each 1 where over half of the hashes of the word shingles of ``text`` have it."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    counts, total = np.zeros(64, dtype=np.int64), 0
    while piece := list(islice(grams, PIECE)):
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in piece), dtype=">u8", count=len(piece))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(piece)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    batches_of_documents(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(read, f"doc_id {kind}, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The five keys that each fingerprint is stored under, the keys that are looked up, and whose look-ups they are."""
    bits = fps.view(np.uint64)
    c = (bits & np.uint64((1 << REST) - 1)).astype(np.int64)
    b = ((bits >> np.uint64(REST)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    a = (bits >> np.uint64(REST + LENGTH)).astype(np.int64)
    (near_a, n_a), (near_b, n_b) = near_codewords(a), near_codewords(b)

    def key(number: int, high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
        return np.int64(number << KEY_BITS) | high << width | low

    def codes(i: int, j: int, own: np.ndarray) -> np.ndarray:
        return key(0, near_a[own, i] << CODE_BITS | near_b[own, j], c[own], REST)

    everyone = np.arange(len(fps))
    exact = [key(1, b, c, REST), key(2, a, c, REST)]
    stored = np.stack([codes(0, 0, everyone), *exact, key(3, near_a[:, 0], b, LENGTH), key(4, a, near_b[:, 0], CODE_BITS)], axis=1)
    asked = [(k, everyone) for k in exact]
    for i in range(MOST_NEAR):
        with_a, with_b = everyone[i < n_a], everyone[i < n_b]
        asked += [(key(3, near_a[with_a, i], b[with_a], LENGTH), with_a), (key(4, a[with_b], near_b[with_b, i], CODE_BITS), with_b)]
        for j in range(MOST_NEAR):
            both = everyone[(i < n_a) & (j < n_b)]
            asked.append((codes(i, j, both), both))
    return stored, np.concatenate([k for k, _ in asked]), np.concatenate([own for _, own in asked])


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fp, stored): where each fingerprint is stored, and where it is looked up."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            stored, asked, owner = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(stored.ravel()), pa.array(np.repeat(fps, stored.shape[1])), pa.array(np.ones(stored.size, dtype=bool))], names=["key", "fp", "stored"])
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(fps[owner]), pa.array(np.zeros(len(asked), dtype=bool))], names=["key", "fp", "stored"])

    return classes.select("fp").mapInArrow(read, "key long, fp long, stored boolean")


def neighbours(fps: DataFrame) -> DataFrame:
    """(fp, other): every word within ``FAR`` bits of each fingerprint."""
    masks = np.array([sum(1 << x for x in bits) for n in range(1, FAR + 1) for bits in combinations(range(64), n)], dtype=np.uint64).view(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False)
            for some in np.array_split(own, max(1, len(own) // 100)):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(masks))), pa.array((some[:, None] ^ masks).ravel())], names=["fp", "other"])

    return fps.mapInArrow(spread, "fp long, other long")


def links(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints of ``classes`` (fp, each once) with at most ``FAR`` differing bits; a pair may repeat."""
    table = materialise(keyed(classes), "keys", by=["stored"])
    stored, asked = (table.where(F.col("stored") == flag).select("key", "fp") for flag in (True, False))
    crowded = materialise(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"), "crowded")
    beyond = None
    if not crowded.isEmpty():
        inside = split_join(stored, crowded, "key", "fp", "left_semi").select("fp").distinct()
        known = classes.select(F.col("fp").alias("other"))
        beyond = neighbours(inside).join(known, "other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        asked = materialise(split_join(asked, crowded, "key", "fp", "left_anti"), "asked")
    met = split_join(asked, stored.withColumnRenamed("fp", "other"), "key", "fp")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    found = met.where(apart.between(1, FAR)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return found if beyond is None else found.unionByName(beyond)


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, of every document."""
    with temporary(docs.sparkSession):
        found = materialise(fingerprints(docs), "fingerprints")
        classes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
        roots = components(links(classes)).withColumnRenamed("node", "fp")
        rooted = materialise(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        by_class = split_join(rooted.select("fp", "root"), named, "root", "fp").select("fp", "component_id")
        out = split_join(found, by_class, "fp", "doc_id", counts=classes.select("fp", "n"))
        return materialise(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components", keep=True)
