"""Packing of token sequences into fixed windows by minimum bin slack.

A document is cut at multiples of the window; whole windows fill a sequence each and are not grouped. What
remains of each document is packed bucket by bucket: the longest remainder opens a window, then a subset-sum
dynamic program over a bitset finds which multiset of remaining lengths comes closest to the space left, and
its counts are read back from the stored bitsets. Only where ``LEAST_CUT`` tokens or more are still free is
the longest remainder left cut to fill them, and its tail goes back to the stock. Buckets are hash partitions
of bounded size, dealt by piece and not by document, so their number grows with the corpus and each is
packed on its own; only the last window of a bucket can be far from full.

Defined cases: a null or empty text has only the end token; repeated rows are packed once each; null
document ids are packed as any other; lengths that tie are taken in row order; very long texts are cut into
whole windows and one remainder; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import byte_letters
from tickloom.llm.common import materialise, text_or_empty

WINDOW = 1024
BUCKET_ROWS = 5_000
#: A window with fewer free tokens than this is left so; a piece of fewer tokens is never cut off to fill one.
LEAST_CUT = 4
MEMO_ENTRIES = 60_000
#: Pieces in one frame that a worker hands on.
FRAME_ROWS = 1_000

#: Fixed value: the splitting rule that a byte-level pre-tokenizer applies (use_regex).
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE_RUN = re.compile(r" \s")
_WORD_START = re.compile(r" (?=\S)")


class _Known(dict):
    """Ids, as little-endian bytes, of each piece between spaces; bounded, and refilled when full."""

    def __init__(self, ids_of: Callable[[str], list[int]], lead: str):
        self.ids_of, self.lead = ids_of, lead

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        ids = self.ids_of(self.lead + part)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            self[part] = out
        return out


class ByteBpe:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    The file's splitting rule starts a token at each space before a visible character, whatever
    surrounds it, so the pieces between such spaces have their ids alone and frequent ones are encoded
    once. Where the file numbers its tokens in merge order, new pieces go to tiktoken, which then gives
    the same ids faster; special strings, and files in another order, go to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        fast = _by_rank(path)

        def ids_of(piece: str) -> list[int]:
            if fast is None or "<|" in piece or len(piece) > 1000:
                return tokenizer.encode(piece, add_special_tokens=False).ids
            return fast(piece)

        self.first, self.rest = _Known(ids_of, ""), _Known(ids_of, " ")

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts = _WORD_START.split(text) if _SPACE_RUN.search(text) else text.split(" ")
        head = self.first[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.rest.__getitem__, parts[1:]))


def _by_rank(path: str) -> Callable[[str], list[int]] | None:
    """tiktoken's encoder for a tokenizers file whose merges are numbered in order; None for any other file."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    merged = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    plain = split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
    if not plain or merged != sorted(set(merged)) or len(merged) + 256 != len(model["vocab"]) or min(merged) < 256:
        return None
    byte_of = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def cuts(tokens: int, window: int) -> list[tuple[int, int]]:
    """Whole windows, then what remains."""
    return list(itertools.pairwise([*range(0, tokens, window), tokens]))


PIECES = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"


def _cutter(path: str, window: int, end_id: int, with_ids: bool):
    """Pieces with a number of their own; ids only where they are asked for or may still be cut."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).ids
        number = itertools.count(TaskContext.get().partitionId() << 36)

        def framed(out: dict[str, list]) -> pd.DataFrame:
            frame = pd.DataFrame(out)
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            return frame

        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                ids = encode(text) + end
                for at, end_at in cuts(len(ids) // 4, window):
                    piece = ids[4 * at : 4 * end_at]
                    out["piece"].append(next(number))
                    out["doc_id"].append(doc_id)
                    out["start"].append(at)
                    out["length"].append(end_at - at)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(ids) // 4)
                    out["ids"].append(piece if with_ids or end_at - at < window else None)
                    if len(out["ids"]) == FRAME_ROWS:
                        yield framed(out)
                        out = defaultdict(list)
            if out:
                yield framed(out)

    return cut


def fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """Counts of each length whose sum comes closest to ``space`` from below.

    ``reach`` has bit s set when some chosen multiset sums to s. Each copy tried keeps the bitset from
    before it, so walking back shows which copies the best sum needs.
    """
    reach, mask, steps = 1, (1 << (space + 1)) - 1, []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        for _ in range(min(counts[length], space // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> space:
                break
        if reach >> space:
            break
    best, used = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(steps):
        if not before >> best & 1:
            used[length] += 1
            best -= length
    return used


def bins_of(lengths: list[int], window: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Minimum bin slack over remainders: windows as lists of (position in ``lengths``, from, to)."""
    stock: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for at in range(len(lengths) - 1, -1, -1):
        stock[lengths[at]].append((at, 0, lengths[at]))
    counts, bins = {x: len(v) for x, v in stock.items()}, []

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return stock[length].pop()

    while counts:
        longest = max(counts)
        held, space = [take(longest)], window - longest
        for length, n in sorted(fill(counts, space).items(), reverse=True):
            held += [take(length) for _ in range(n)]
            space -= n * length
        if space >= least_cut and counts:  # all that is left is longer than the space
            at, begin, end = take(max(counts))
            held.append((at, begin, begin + space))
            rest = (at, begin + space, end)
            stock[end - begin - space].append(rest)
            counts[end - begin - space] = counts.get(end - begin - space, 0) + 1
        bins.append(held)
    return bins


def _packer(window: int, with_ids: bool):
    def pack(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("piece", ignore_index=True)
        held = [(n, at, begin, end) for n, window_parts in enumerate(bins_of(bucket["length"].tolist(), window)) for at, begin, end in window_parts]
        sequence, at, begin, end = (np.array(x, dtype=np.int64) for x in zip(*held))
        out = bucket.iloc[at].reset_index(drop=True)
        whole = (end - begin) == out["length"].to_numpy()
        out["length"] = end - begin
        out["start"] += begin
        firsts = np.searchsorted(sequence, sequence)
        before = np.cumsum(out["length"]) - out["length"]
        out["offset"] = before - before.to_numpy()[firsts]
        out["sequence_id"] = ((int(bucket["bucket"].iloc[0]) << 32) + sequence) * 2
        parts = [ids[4 * b : 4 * e] for ids, b, e in zip(out["ids"], begin.tolist(), end.tolist())]
        out["ids_crc32"] = [crc if same else zlib.crc32(part) for crc, same, part in zip(out["ids_crc32"], whole, parts)]
        out["ids"] = parts if with_ids else None
        return out[[c.split()[0] for c in PLACED.split(", ")]]

    return pack


def _as_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), FRAME_ROWS):
            part = batch.iloc[at : at + FRAME_ROWS]
            yield part.assign(ids=[np.frombuffer(ids, dtype="<i4") for ids in part["ids"]])


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = 0, with_ids: bool = True, as_arrays: bool = True, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, ids (unless ``with_ids`` is false: an array, or without
    ``as_arrays`` the ids as little-endian 32-bit numbers), sequence_id, offset. ``bucket_rows`` bounds how many remainders are packed together on average.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = materialise(texts.mapInPandas(_cutter(tokenizer_path, window, end_id, with_ids), PIECES), "pieces")
    rest = pieces.where(F.col("length") < window)
    buckets = max(1, -(-rest.count() // bucket_rows))
    whole = pieces.where(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    packed = whole.unionByName(dealt.groupBy("bucket").applyInPandas(_packer(window, with_ids), PLACED))
    if not with_ids:
        return packed.drop("ids")
    return packed.mapInPandas(_as_arrays, PLACED.replace("ids binary", "ids array<int>")) if as_arrays else packed
