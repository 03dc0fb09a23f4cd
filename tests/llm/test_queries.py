import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
from riskweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ids(spark):
    return sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "folds", "held", "threshold"), [("op5_quality_classifier", 5, 0, 0.3), ("op7_toxicity", 3, 1, 0.7)])
def test_classifiers_keep_folds_and_thresholds(spark, ids, name, folds, held, threshold):
    rows = queries.queries()[name](spark, SF)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and dict(rows.dtypes)["held_out"] == "boolean" and dict(rows.dtypes)["predicted"] == "int"
    found = rows.collect()
    assert sorted(r.doc_id for r in found) == ids
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


@pytest.mark.parametrize(("name", "held"), [("op5_quality_classifier", (5, 0)), ("op7_toxicity", (3, 1))])
def test_classifiers_dont_learn_from_held_out_labels_and_take_odd_rows(spark, tmp_path, name, held):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "CAST(NULL AS BIGINT) AS n_chars")
    docs.select("doc_id", "text", "lang", "source", docs.n_chars.cast("long").alias("n_chars")).union(odd).union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", *[f"CASE WHEN pmod(crc32(CAST(doc_id AS STRING)), {held[0]}) = {held[1]} THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    flipped.write.parquet(str(tmp_path / "labels.parquet"))
    plain = {r.doc_id: r.score for r in queries.queries()[name](spark, SF).collect()}
    other = queries.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.score for r in other if r.doc_id is not None} == plain
    assert [(r.held_out, 0 <= r.score <= 1) for r in other if r.doc_id is None] == [(False, True)] * 2


def test_packing_and_shards_have_each_document(spark, ids):
    packed = queries.op8_best_fit_packing(spark, SF).toPandas()
    assert set(packed["doc_id"]) == set(ids) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]]
    shards = queries.op3_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in shards) == ids and {r.version for r in shards} <= {1, 2}


def test_vector_queries_have_each_vector(spark):
    vectors = sorted(r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect())
    near = queries.op9_embedding_near_dedup(spark, SF)
    assert near.columns[:4] == ["vec_id", "n_links", "component_id", "kept"] and sorted(r.vec_id for r in near.collect()) == vectors
    top = queries.op10_exact_topk(spark, SF).toPandas()
    assert set(top["query_id"]) == {v for v in vectors if v % 20 == 0} and (top.groupby("query_id")["rank"].max() == 20).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as duck:
        for table in ("documents", "embeddings"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
        wanted = duck.execute(queries.oracle_sql()[name])
        columns, rows = [c[0] for c in wanted.description], wanted.fetchall()
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns) and rows
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(rows)
