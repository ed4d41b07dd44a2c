"""Fingerprints, the code behind their keys, and their components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tickloom.llm import golay, simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint, smallest id reachable) by joining every pair that is near."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc_id)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(map(repr, ((d, format(fps[i], "016x"), smallest[top(i)]) for i, (d, _) in enumerate(rows))))


def got(df):
    return sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())))


def test_code_covers_every_word():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    near, count = golay.near_codewords(words)
    checks = golay.tables()[0]
    whole = near << 11 | checks[near]
    apart = np.bitwise_count(whole ^ words[:, None])
    assert apart[:, 0].max() == 3 and apart.max() == 4 and set(count) == {1, 6}
    every = np.arange(4096) << 11 | checks
    assert all((np.bitwise_count(every ^ w) <= 4).sum() == n for w, n in zip(words[:300], count[:300]))


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_near_fingerprints_share_a_key(flips):
    rng = random.Random(flips)
    own = [rng.getrandbits(64) for _ in range(3000)]
    other = [f ^ sum(1 << b for b in rng.sample(range(64), flips)) for f in own]
    stored = simhash.keys_of(np.array(own, dtype=np.uint64).view(np.int64))[0]
    _, asked, owner = simhash.keys_of(np.array(other, dtype=np.uint64).view(np.int64))
    keys = [set() for _ in own]
    for k, o in zip(asked.tolist(), owner.tolist()):
        keys[o].add(k)
    assert all(keys[i] & set(stored[i].tolist()) for i in range(len(own)))


def test_long_text_counts_in_pieces(monkeypatch, prose):
    text = prose(500, 3)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_odd_rows(spark, hard_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    assert got(simhash.near_components(hard_docs)) == plain_components(rows)


def test_empty(spark, no_docs):
    assert simhash.near_components(no_docs).count() == 0


@pytest.mark.parametrize("crowded", [2000, 3])
def test_components_of_near_copies(spark, prose, monkeypatch, crowded):
    """Chains of near copies; with few stored fingerprints a key allowed, neighbours are looked up instead."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng, rows = random.Random(5), []
    for base in range(40):
        words = prose(150, base).split()
        for step in range(12):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = f"w{step}"
    rng.shuffle(rows)
    rows += [(9000 + i, t) for i, t in enumerate(["a b", "A b", "", None, "a", "b", "c d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert got(simhash.near_components(docs)) == want
    assert len({w.rsplit(",", 1)[1] for w in want}) < len(rows) - 100


def test_small_table(spark, some_docs):
    rows = [(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()]
    assert got(simhash.near_components(some_docs)) == plain_components(rows)
