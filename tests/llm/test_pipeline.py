"""The pipeline against a plain reading of its stages, on a table with odd rows."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_free import groups_by_hand
from test_native import SECRETS, lines_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import quality, secrets
from tickloom.llm.common import fold

SMALL = "/root/testdata/sf0.001"
MORE = [
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", lambda m: True),
    ("forge", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", lambda m: True),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", lambda m: True),
]


def redacted(text):
    spans = sorted((m.start(), m.end()) for _, pattern, ok in [*SECRETS, *MORE] for m in re.finditer(pattern, text) if ok(m))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out.append(text[at:start] + "[secret]")
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    """The small documents with repeated rows, nulls, repeated ids, secrets, and an extra column."""
    base = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = ". ".join(prose(12, seed) for seed in range(8)) + "."
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, text, "en", None, 1), (70_001, text.replace(".", ","), "en", "s", 2), (70_001, text[::-1], "en", "s", 3), (70_002, "", None, None, 0)]
        + [(70_003, text + " api_key = abcdef0123456789 end", "en", "s", 4)],
        docs.schema,
    )
    whole = docs.unionByName(odd).unionByName(docs.limit(5))
    whole.withColumns({"line_hash": F.lit("own"), "n_removed": F.lit(7)}).coalesce(2).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_pipeline_is_its_stages(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score_quality(docs, labels, fold(F.col("doc_id")) != 2).groupBy("doc_id", "score").count().collect()
    good = corpus_pipeline.keep_good(spark, docs, folder).collect()
    assert good and {(r.doc_id) for r in good} <= {r.doc_id for r in scored if r.score >= 0.7}
    assert len(good) == sum(r["count"] for r in scored if r.score >= 0.7)
    lined = [(i, t) for i, t, _ in lines_by_hand(good, 10)]
    classes = groups_by_hand([(p, t) for p, (_, t) in enumerate(lined)], 0.8)
    members = defaultdict(list)
    for place, name, *_ in classes:
        members[name].append(lined[place])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(dict)
    for p in corpus_pipeline.run(spark, folder).collect():
        got[p.doc_id, p.doc_tokens].setdefault(p.start, []).append(np.frombuffer(p.ids, dtype="<u4").tolist())
    whole = [(key[0], [i for start in sorted(parts) for i in parts[start][k]]) for key, parts in got.items() for k in range(len(next(iter(parts.values()))))]
    texts = sorted(str((i, tokenizer.decode(ids[:-1], skip_special_tokens=False))) for i, ids in whole)
    assert all(ids[-1] == 0 for _, ids in whole)

    def smallest(rows):
        named = [r for r in rows if r[0] is not None]
        least = min(i for i, _ in named) if named else None
        return {str((i, redacted(t or ""))) for i, t in rows if i == least}

    choices = [smallest(rows) for rows in members.values()]
    assert len(texts) == len(choices)
    assert all(sum(t in c for t in texts) >= 1 for c in choices) and all(any(t in c for c in choices) for t in texts)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.line_hash == "own" and r.n_removed == 7 for r in rows)
        if name in ("line dedup", "secret scans"):
            assert all(r.text is None or r.n_chars == len(r.text) for r in rows)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_of_this_reading_are_those_of_the_operator():
    assert [k for k, *_ in [*SECRETS, *MORE]] == [r.kind for r in secrets.RULES]
