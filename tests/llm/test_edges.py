"""Cases at the edges: nothing to learn from, lines without a visible character, words of other scripts, many languages."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import language, line_dedup, pii, quality
from tickloom.llm.common import fold

def learned():
    return fold(F.col("doc_id")) != 2


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def test_without_positives_every_document_stays(some_docs, labels):
    bad = labels.withColumn("quality", F.lit(0))
    assert quality.keep_good(some_docs, bad, learned(), 0.7).count() == some_docs.count()
    assert {r.score for r in quality.score_quality(some_docs, bad, learned()).collect()} == {0.5}


def test_every_document_with_a_label(some_docs, labels):
    """The labelled texts are then the unlabelled sample as well, and scores tell good from bad as before."""
    own = some_docs.join(labels.select("doc_id", "quality"), "doc_id")
    scored = quality.score_quality(own, own.select("doc_id", "quality"), learned())
    by_mark = {r.quality: r.mean for r in scored.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("mean")).collect()}
    assert by_mark[1] > by_mark[0] + 0.2
    assert 0 < quality.keep_good(own, own.select("doc_id", "quality"), learned(), 0.7).count() < own.count()


def test_lines_of_white_space_stay(spark):
    docs = spark.createDataFrame([(i, "a\n\t\n \x0b\r\nspread", f"site{i}") for i in range(12)], "doc_id long, text string, source string")
    rows = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, *[2] * 11]
    assert {r.text for r in rows[1:]} == {"\t\n \x0b\r"}


@pytest.mark.parametrize("word, raised", [("tel", True), ("hôtel", False), ("hotel", False), ("TÉL-tel:", True), ("hôtel", False), ("téléphone", True), ("9tel", False), ("отtel", False)])
def test_context_words_are_whole_in_every_script(spark, word, raised):
    docs = spark.createDataFrame([(1, f"{word} +49 30 1234567")], "doc_id long, text string")
    assert pii.pii_digests(docs).first().scores == ("0.70" if raised else "0.60")


def test_rare_languages_are_learned_or_refused(spark, prose):
    rows = [(i, f"{prose(30, i % 6)} {'xyzq'[i % 4] * 5}", f"l{i % 6}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(set(language.training_rows(docs, F.lit(True))[1])) == 6
    with pytest.raises(ValueError, match="max_languages"):
        language.training_rows(docs, F.lit(True), max_languages=5)
