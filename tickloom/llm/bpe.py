"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary is a public word-level BPE file: words end in a marked symbol, text is NFC-normalised
and lower-cased, white space is dropped. Frequent words are encoded once per worker; the memory for
that is bounded. Decoding joins the vocabulary strings of the ids with one space, as the file's
missing decoder asks for.

Defined cases: a null or empty text, or one of white space alone, has no tokens and decodes to the
empty string; the file's special strings in a text become their ids; of merges that tie in rank the leftmost
comes first; repeated rows give repeated rows; very long texts and words are encoded whole (the queue grows with
the word alone); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_or_empty

MEMO_ENTRIES = 500_000
ID_BITS, PLACE_BITS = 20, 32
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1
_WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_CONTROLS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_word(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the lowest-ranked adjacent pair, leftmost first, until no ranked pair is left.

    ``merges``: pair (two ids in one number) -> rank and id of the merged symbol (in one number). The queue holds
    rank and place; an entry whose place no longer has a pair of that rank is stale and skipped.
    """
    n, find = len(ids), merges.get
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(m >> ID_BITS) << PLACE_BITS | i for i in range(n - 1) if (m := find(ids[i] << ID_BITS | ids[i + 1])) is not None]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i = entry & PLACE_MASK
        j = right[i]
        if j < 0 or ids[i] < 0:
            continue
        m = find(ids[i] << ID_BITS | ids[j])
        if m is None or m >> ID_BITS != entry >> PLACE_BITS:
            continue
        ids[i], ids[j] = m & ID_MASK, -1
        k = right[i] = right[j]
        right[j] = -1
        if k >= 0:
            left[k] = i
            if (m := find(ids[i] << ID_BITS | ids[k])) is not None:
                heappush(queue, (m >> ID_BITS) << PLACE_BITS | i)
        h = left[i]
        if h >= 0 and (m := find(ids[h] << ID_BITS | ids[i])) is not None:
            heappush(queue, (m >> ID_BITS) << PLACE_BITS | h)
    return [x for x in ids if x >= 0]


class _Runs(dict):
    """Tokens of each run without white space seen so far; bounded, and refilled when full."""

    def __init__(self, encode: Callable[[str], tuple[int, str, str]]):
        self.encode = encode

    def __missing__(self, run: str) -> tuple[int, str, str]:
        out = self.encode(run)
        if len(run) <= 48:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[run] = out
        return out


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + end] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.runs = _Runs(self.run)
        self.known = _Runs(self.word)

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of tokens, their ids and their vocabulary strings of one lower-cased word."""
        code = word.encode()
        ids = [self.inner[b] for b in code]
        ids[-1] = self.final[code[-1]]
        if len(ids) > 1:
            ids = merge_word(ids, self.merges)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def run(self, run: str) -> tuple[int, str, str]:
        """The same for a run without white space."""
        if run.isascii() and run.isalpha():
            return self.word(run) if run.islower() else self.known[run.lower()]
        parts = self.words.findall(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())
        if len(parts) == 1:
            return self.known[parts[0]]
        counts, ids, strings = zip(*map(self.known.__getitem__, parts))
        return sum(counts), " ".join(ids), " ".join(strings)

    def found(self, text: str) -> list[tuple[int, str, str]]:
        parts = [x for x in _WHITE.split(text) if x] if _CONTROLS.search(text) else text.split()
        return list(map(self.runs.__getitem__, parts))

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, decimal ids and decoded text."""
        if "<|" in text and self.cut.search(text):
            found = []
            for part in self.cut.split(text):
                special = self.special.get(part)
                found += self.found(part) if special is None else [(1, str(special), part)]
        else:
            found = self.found(text)
        if not found:
            return 0, "", ""
        counts, ids, strings = zip(*found)
        return sum(counts), " ".join(ids), " ".join(strings)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def _pairs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = codec(tokenizer_path).encode_text
        for batch in batches:
            batch["ids"] = [[int(x) for x in run(t)[1].split()] for t in batch.pop("text")]
            yield batch

    return _pairs(docs).mapInPandas(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids decode to the empty string."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = codec(tokenizer_path).decode
        for batch in batches:
            batch["text"] = [run([int(i) for i in ids]) if ids is not None else "" for ids in batch.pop("ids")]
            yield batch

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(decode, "doc_id long, text string")


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, without moving the ids themselves."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = codec(tokenizer_path).encode_text
        for batch in batches:
            found = [run(t) for t in batch.pop("text")]
            batch["n_tokens"] = [f[0] for f in found]
            batch["ids_sha256"] = [hashlib.sha256(f[1].encode()).hexdigest() for f in found]
            batch["decoded_sha256"] = [hashlib.sha256(f[2].encode()).hexdigest() for f in found]
            yield batch

    return _pairs(docs).mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
