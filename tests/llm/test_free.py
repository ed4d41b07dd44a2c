"""The operators in a free style against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, components, language, near_dup, packing, quality, vectors
from tickloom.llm.common import fold

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, text):
    tokenizer = Tokenizer.from_file(path)
    return tokenizer, tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["hard_docs", "some_docs"])
def test_packing(which, request):
    docs = request.getfixturevalue(which).withColumn("doc_id", F.monotonically_increasing_id())
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = packing.pack_documents(docs, BYTE_BPE, bucket_rows=50).collect()
    got, windows = defaultdict(dict), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.asarray(p.ids, dtype="<u4").tobytes())
        got[p.doc_id][p.start] = p.ids
        windows[p.sequence_id].append((p.offset, p.length))
    assert {d: [i for start in sorted(parts) for i in parts[start]] for d, parts in got.items()} == want
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([0, *[n for _, n in sorted(parts)][:-1]]))
        assert sum(n for _, n in parts) <= packing.WINDOW


def test_packing_fills_windows():
    rng = random.Random(1)
    lengths = [b - a for _ in range(3000) for a, b in packing.cuts(rng.randint(1, 3000), 1024)[-1:]]
    bins = packing.bins_of(lengths, 1024)
    covered = defaultdict(list)
    for held in bins:
        for at, begin, end in held:
            covered[at].append((begin, end))
    for at, n in enumerate(lengths):
        parts = sorted(covered[at])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    sums = [sum(end - begin for _, begin, end in held) for held in bins]
    assert max(sums) <= 1024 and all(n > 1024 - packing.LEAST_CUT for n in sums[:-1])
    assert sum(len(parts) > 1 for parts in covered.values()) / len(lengths) <= 0.1


def test_long_remainders_alone_are_cut():
    bins = packing.bins_of([700] * 40, 1024)
    assert len(bins) == -(-700 * 40 // 1024)


def test_cuts():
    assert packing.cuts(1, 1024) == [(0, 1)] and packing.cuts(1024, 1024) == [(0, 1024)] and packing.cuts(2048, 1024) == [(0, 1024), (1024, 2048)]
    assert packing.cuts(1700, 1024) == [(0, 1024), (1024, 1700)]


def test_padding_of_the_query(spark):
    from tickloom.llm.queries import QUERIES

    rows = QUERIES["op2_packing"](spark, "/root/testdata/sf0.01").collect()
    ends = defaultdict(int)
    for r in rows:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    tokens = sum(r.length for r in rows)
    assert max(ends.values()) <= 1024 and len(ends) <= tokens / 1024 * 1.003 + 1


def test_packing_of_repeated_rows_in_many_buckets(spark):
    docs = spark.createDataFrame([(1, "the same words again and again " * 20)] * 300, "doc_id long, text string")
    packed = packing.pack_documents(docs, BYTE_BPE, with_ids=False, bucket_rows=20)
    rows = packed.collect()
    assert len({r.sequence_id // 2 >> 32 for r in rows}) > 5
    assert sum(r.length for r in rows) == 300 * rows[0].doc_tokens


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_best(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
    items = [x for x, n in counts.items() for _ in range(n)]
    best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= 64)
    used = packing.fill(counts, 64)
    assert sum(x * n for x, n in used.items()) == best and all(counts[x] >= n for x, n in used.items())


@pytest.mark.parametrize("which", ["hard_docs", "some_docs"])
def test_bpe(which, request):
    docs = request.getfixturevalue(which).withColumn("doc_id", F.monotonically_increasing_id())
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    encoded = bpe.encode_documents(docs, WORD_BPE)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert ids == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    decoded = {r.doc_id: r.text for r in bpe.decode_documents(encoded, WORD_BPE).collect()}
    assert decoded == {d: tokenizer.decode(i, skip_special_tokens=False) for d, i in ids.items()}
    for r in bpe.encode_digests(docs, WORD_BPE).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id].encode()).hexdigest()


def groups_by_hand(rows, threshold):
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent, degree = list(range(len(sets))), [0] * len(sets)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(sets[a] & sets[b])
        if common and common / len(sets[a] | sets[b]) >= threshold:
            degree[a] += 1
            degree[b] += 1
            parent[root(a)] = root(b)
    classes = defaultdict(list)
    for k, ids in enumerate(texts.values()):
        classes[root(k)] += [i for i in ids if i is not None]
    return sorted(((i, min(classes[root(k)], default=None), degree[k], len(ids)) for k, ids in enumerate(texts.values()) for i in ids), key=str)


def copies(prose):
    """Families of near copies of several sizes, with exact copies among them."""
    rng, rows = random.Random(3), []
    for family, size in enumerate((1, 2, 3, 30, 60)):
        words = prose(200, family).split()
        for _ in range(size):
            own = list(words)
            for at in rng.sample(range(200), 3):
                own[at] = f"w{rng.randint(0, 3)}"
            rows.append(" ".join(own))
    return [(i, t) for i, t in enumerate([*rows, *rows[::7], rows[1].upper(), "a b", "a  b", "", None])]


@pytest.mark.parametrize("chunk", [400_000, 3000])
def test_near_groups(spark, prose, chunk, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_GRAMS", chunk)
    rows = copies(prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "uid": F.lit(2), "n": F.lit(3)})
    got = sorted((tuple(r)[:4] for r in near_dup.near_groups(docs).collect()), key=str)
    assert got == groups_by_hand(rows, 0.8)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g[1] for g in got})


@pytest.mark.parametrize("which", ["hard_docs", "some_docs"])
def test_near_groups_of_tables(which, request):
    docs = request.getfixturevalue(which)
    got = sorted((tuple(r)[:4] for r in near_dup.near_groups(docs).collect()), key=str)
    assert got == groups_by_hand([(r.doc_id, r.text) for r in docs.collect()], 0.8)


def test_banding_reaches_its_recall():
    bands, rows = near_dup.banding(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    chain = [(i + 1, i) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 40)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}
    assert components.components(edges.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    data[100:160] = data[100]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0, None] * 8), (9080, [1.0] * 3), (9100, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit("x"), "ids": F.lit(1), "vector": F.lit(2)})
    got = defaultdict(list)
    for r in vectors.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=1000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = data.astype(np.float32).astype(np.float64)
    found = total = 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, rows in got.items():
        scores = exact @ exact[q]
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - scores[i]) < 1e-9 for i, s in rows)
        found += len(set(order) & {i for i, _ in rows})
        total += 20
    assert found / total >= 0.95
    few = table.where("vec_id < 5")
    assert vectors.nearest(few, F.col("vec_id") == 0).count() == 4
    assert vectors.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 .. 3", "en"), (-3, "", None), (-4, "é", None)], docs.schema)
    found = language.identify(docs.unionByName(odd), fold(F.col("doc_id")) != 2)
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0 and got[-4].lang_pred in {"en", "fr", "de", "es"}
    held = docs.where(fold(F.col("doc_id")) == 2).collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    blind = language.identify(docs.limit(20), F.lit(False))
    assert {r.lang_pred for r in blind.collect()} == {"und"}


def test_language_kernel_is_shared_ngrams():
    a, b = language.presence("abc"), language.presence("abd")
    grams = [{f" {t} "[i : i + n] for n in range(1, 5) for i in range(len(t) + 3 - n)} for t in ("abc", "abd")]
    assert (a & b).sum() == len(grams[0] & grams[1]) and a.sum() == len(grams[0])


def test_quality(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    usable = fold(F.col("doc_id")) != 2
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels, usable).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where(~usable).collect()]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    kept = quality.keep_good(docs, labels, usable, 0.7)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in got.items() if s >= 0.7}


def test_quality_of_odd_rows(hard_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    usable = fold(F.col("doc_id")) != 2
    assert {r.score for r in quality.score_quality(hard_docs, none, usable).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_quality(hard_docs, some, F.lit(True)).count() == hard_docs.count()
    assert quality.score_quality(no_docs, some, usable).count() == 0


def test_risk_does_not_use_negatives_and_is_bounded_below():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (300, 22)), rng.normal(-1, 0.3, (100, 22))
    model = quality.fit(good[:150], np.vstack([good[150:], bad]), 0.6)
    assert (model.logits(good) > 0).mean() > 0.95 and (model.logits(bad) < 0).mean() > 0.95


def test_empty_and_odd_tables(no_docs, hard_docs):
    assert packing.pack_documents(no_docs, BYTE_BPE).count() == 0
    assert bpe.encode_digests(no_docs, WORD_BPE).count() == 0
    assert near_dup.near_groups(no_docs).count() == 0
    assert language.identify(no_docs, F.lit(True)).count() == 0
    assert packing.pack_documents(hard_docs, BYTE_BPE).select("doc_id").distinct().count() == hard_docs.select("doc_id").distinct().count()


def test_pipeline_stages_keep_columns_and_work_on_what_is_left(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_risk_gradient_is_the_slope_of_the_risk():
    rng = np.random.default_rng(8)
    p, u = rng.normal(0.5, 1, (30, 5)), rng.normal(0, 1, (40, 5))
    layers = [rng.normal(0, 0.5, (5, 4)), rng.normal(0, 0.1, 4), rng.normal(0, 0.5, 4), np.array([0.2])]
    for prior, sign in ((0.3, 1), (0.95, -1)):
        if sign < 0:
            layers[3] = np.array([4.0])  # all are called positive: the second part falls below 0

        def part():
            first, second = quality.risk(layers, p, u, prior)
            return first + second if second >= 0 else -second

        if sign < 0:
            u = rng.normal(-0.5, 0.1, (40, 5))
            layers[2] = np.array([-6.0, 0, 0, 0])
            layers[3] = np.array([0.0])
        got = quality.risk_gradient(layers, p, u, prior)
        for layer, g in zip(layers, got):
            for at in np.ndindex(layer.shape):
                kept = layer[at]
                layer[at] = kept + 1e-6
                high = part()
                layer[at] = kept - 1e-6
                low = part()
                layer[at] = kept
                assert abs((high - low) / 2e-6 - g[at]) < 1e-4


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_is_estimated_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(9)
    good, bad = (lambda n: rng.normal(1, 0.6, (n, 6))), (lambda n: rng.normal(-1, 0.6, (n, 6)))
    n = int(1500 * share)
    got = quality.estimate_prior(good(800), np.vstack([good(n), bad(1500 - n)])[rng.permutation(1500)])
    assert abs(got - share) < 0.06


def test_quality_does_not_read_labels_of_zero(spark):
    """The score is the same whichever of the labelled bad rows are there, once their ids are known to be labelled."""
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet").where("quality is not null")
    usable = F.lit(True)
    want = sorted(tuple(r) for r in quality.score_quality(docs, labels, usable).collect())
    odd = labels.withColumn("quality", F.when(F.col("quality") == 0, -5).otherwise(F.col("quality")))
    assert sorted(tuple(r) for r in quality.score_quality(docs, odd, usable).collect()) == want


def test_sample_is_bounded_where_ids_repeat(spark):
    rows = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, "same")] * 500, "doc_id long, text string")
    assert len(quality._sample(rows, 50, 1)) <= 50
    texts, _ = language.training_rows(rows.withColumn("lang", F.lit("en")), F.lit(True), per_language=30)
    assert 0 < len(texts) <= 60


def ridge_by_hand(train, languages, texts):
    """One-versus-rest kernel ridge regression in its dual form over sets of n-grams, without landmarks or hashing."""

    def grams(text):
        padded = f" {text.lower()} "
        return {padded[i : i + n] for n in range(1, language.ORDER + 1) for i in range(len(padded) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])

    own, names = [grams(t) for t in train], sorted(set(languages))
    targets = np.array([[x == n for n in names] for x in languages], dtype=float)
    d = (1 / np.sqrt(targets.sum(axis=0)))[targets.argmax(axis=1)]
    k = kernel(own, own) + 1
    ridge = language.RIDGE * (d * d * k.diagonal()).sum() / (len(train) + 1)
    dual = d[:, None] * np.linalg.solve(d[:, None] * k * d[None, :] + ridge * np.eye(len(train)), d[:, None] * targets)
    raw = np.maximum((kernel([grams(t) for t in texts], own) + 1) @ dual, 1e-6)
    return [names[i] for i in raw.argmax(axis=1)], raw.max(axis=1) / raw.sum(axis=1)


def test_language_is_kernel_ridge_regression(spark, monkeypatch):
    """With every training text a landmark, the query's operator gives what the dual form gives."""
    monkeypatch.setattr(language, "LANDMARKS_PER_LANGUAGE", 10_000)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 30 and 1500 and lang is not null")
    docs = rows.dropDuplicates(["text"]).orderBy("doc_id").limit(90).cache()
    held = docs.collect()
    train = [(r.text, r.lang) for r in held if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    names, sure = ridge_by_hand([t for t, _ in train], [x for _, x in train], [r.text for r in held])
    got = {r.doc_id: r for r in language.identify(docs, fold(F.col("doc_id")) != 2, per_language=10_000).collect()}
    assert [got[r.doc_id].lang_pred for r in held] == names
    assert max(abs(got[r.doc_id].score - s) for r, s in zip(held, sure)) < 0.02
