"""Links inside a chunk are counted once, also where the other chunk of a unit has no text."""

import pandas as pd
from test_free import groups_by_hand

from tickloom.llm import near_dup


def test_unit_with_an_empty_chunk(prose):
    a = prose(60, 1)
    rows = [(7, low, high, uid, 0, text) for low, high in ((0, 0), (0, 1)) for uid, text in ((1, a), (2, a + " end"))]
    batch = pd.DataFrame(rows, columns=["cluster", "low", "high", "uid", "chunk", "text"])
    got = pd.concat(near_dup._verifier(0.8)(iter([batch])))
    assert got.groupby("uid").links.sum().to_dict() == {1: 1, 2: 1}


def test_links_of_pairs_in_two_parts(spark, prose, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_GRAMS", 3000)
    rows = [(2 * f + k, prose(2400, f) + " end" * k) for f in range(8) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in near_dup.near_groups(docs).collect()), key=str)
    assert got == groups_by_hand(rows, 0.8)


def test_chunks_that_no_bucket_joins_are_not_compared(spark, prose, monkeypatch):
    """A chain of clusters through shared buckets: still every link, each once."""
    monkeypatch.setattr(near_dup, "CHUNK_GRAMS", 1500)
    monkeypatch.setattr(near_dup, "LEAST_WEIGHT", 200)
    words = [prose(220, 40 + f).split() for f in range(6)]
    rows = []
    for f in range(6):
        for k in range(5):
            mixed = words[f][: 220 - 6 * k] + words[(f + 1) % 6][: 6 * k]
            rows.append((10 * f + k, " ".join(mixed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in near_dup.near_groups(docs).collect()), key=str)
    assert got == groups_by_hand(rows, 0.8)


def test_class_key_tells_classes_with_one_id_apart(spark, prose):
    a, b = prose(60, 1), prose(60, 2)
    docs = spark.createDataFrame([(6, a), (6, b), (7, a + " end"), (8, b + " end")], "doc_id long, text string")
    rows = near_dup.near_groups(docs).collect()
    assert {r.class_id for r in rows} == {6} and len({r.class_key for r in rows}) == 2


def test_rows_of_a_large_group_grow_with_its_texts(spark, prose, monkeypatch):
    """Each text leaves the comparisons once for its chunk and once for all others, however many chunks there are."""
    monkeypatch.setattr(near_dup, "CHUNK_GRAMS", 2500)
    monkeypatch.setattr(near_dup, "LEAST_WEIGHT", 100)
    made, materialise = [], near_dup.materialise

    def counted(df, label, **options):
        out = materialise(df, label, **options)
        if label in ("verified", "within", "across"):
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "materialise", counted)
    base = prose(110, 3).split()
    rows = [(n, " ".join([*base[:n], f"w{n}", *base[n + 1 :]])) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in near_dup.near_groups(docs).collect()), key=str)
    assert got == groups_by_hand(rows, 0.8)
    assert 100 <= sum(made) < 250
