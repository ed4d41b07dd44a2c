"""One row of each class of near copies stays, with ids that are null or repeated as well."""

from test_free import groups_by_hand

from tickloom.llm import near_dup


def texts_kept(docs):
    return sorted((r.doc_id, r.text) for r in near_dup.keep_one(docs).collect())


def test_keep_one_of_rows_without_ids(spark, prose):
    texts = [prose(60, seed) for seed in range(6)]
    docs = spark.createDataFrame([(None, t) for t in [*texts, texts[0], texts[1] + " end"]], "doc_id long, text string")
    kept = [r.text for r in near_dup.keep_one(docs).collect()]
    assert len(kept) == 6 and set(texts) - {texts[1]} <= set(kept)


def test_keep_one_of_repeated_ids(spark, prose):
    a, b, c = (prose(60, seed) for seed in range(3))
    docs = spark.createDataFrame([(1, a), (2, a + " end"), (2, b), (3, b), (4, c), (4, c)], "doc_id long, text string")
    assert texts_kept(docs) == sorted([(1, a), (2, b), (4, c)])


def test_keep_one_on_hard_docs(hard_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    kept = near_dup.keep_one(hard_docs)
    assert kept.columns == hard_docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    # Classes of this table, with a place in the table as id, which no two rows share.
    own = {p: c for p, c, *_ in groups_by_hand([(p, t) for p, (_, t) in enumerate(rows)], 0.8)}
    of = {}
    for p, (_, t) in enumerate(rows):
        of[t or ""] = own[p]
    assert sorted(of[t or ""] for _, t in found) == sorted(set(own.values()))
