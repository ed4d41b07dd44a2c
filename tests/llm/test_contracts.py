"""The registered queries: names, types, and what SQL gives on the small tables."""

import duckdb
import pytest

from tickloom.llm.oracles import ORACLES
from tickloom.llm.queries import QUERIES

BASE = "/root/testdata/sf0.01"

CONTRACTS = {
    "op2_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_near_dup": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op5_vectors": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_pii": {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op11_conversations": {"conv_id": "bigint", **{n: "bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "string", "repaired_sha256": "string"},
    "op12_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op13_centroids": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op10_secrets": {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("assign", "access", "hex")}, "base_sha256": "string", "spans": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, BASE)
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    docs = spark.read.parquet(f"{BASE}/documents.parquet").count()
    if "doc_id" in CONTRACTS[name] and name != "op2_packing":
        assert got.count() == docs
    elif name == "op2_packing":
        assert got.select("doc_id").distinct().count() == docs
    elif "conv_id" in CONTRACTS[name]:
        assert got.count() == spark.read.parquet(f"{BASE}/conversations.parquet").select("conv_id").distinct().count()
    elif name == "op13_centroids":
        assert got.count() == spark.read.parquet(f"{BASE}/embeddings.parquet").count()
    else:
        assert got.count() == 20 * spark.read.parquet(f"{BASE}/embeddings.parquet").where("vec_id % 20 = 0").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{BASE}/{table}.parquet')")
    got, want = QUERIES[name](spark, BASE).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(frame):
        return sorted(tuple(map(str, r)) for r in frame[columns].fillna("").itertuples(index=False))

    assert rows(got) == rows(want)
