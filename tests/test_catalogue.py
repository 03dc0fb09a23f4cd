import duckdb
import pytest

from pyspark.sql import functions as F

from riskweave.operators import synth
from riskweave.plans import catalogue
from riskweave.sources import LABELLED, load_json, mib, read_rows, report, save_json, write_splits
from riskweave.streaming import decisions_stream, run_available

SF = "/root/testdata/sf0.001"
TABLES = "orders documents embeddings events benchmark labels conversations pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    compare(duck, catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalogue.FIXED))
def test_fixed_cases_equal_sql(spark, duck, name):
    query, sql = catalogue.FIXED[name]
    compare(duck, query(spark, SF), sql)
    assert name not in catalogue.queries()


def compare(duck, df, sql):
    found = duck.execute(sql)
    names, rows = [x[0] for x in found.description], found.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    run_available(decisions_stream(spark, str(tmp_path / "in"), docs.schema).select("doc_id", "action", "policy_reason"), str(tmp_path / "out"), str(tmp_path / "check"))
    from riskweave.plans.analyze import rule_decisions

    batch = rule_decisions(spark.read.parquet(str(tmp_path / "in"))).select("doc_id", "action", "policy_reason")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_files(spark, tmp_path):
    rows = synth.corpus(spark, 2200).withColumn("split", synth.split_of(F.col("family"))).selectExpr("text", "category", "family", "language", "struct(pii, secret, prompt_injection, dangerous_instruction, privacy_risk, security_risk, ethics_risk, oversight_risk, data_governance_risk) AS labels", "action", "severity", "source", "split")
    write_splits(rows, str(tmp_path / "splits"))
    assert read_rows(spark, str(tmp_path / "splits"), LABELLED).count() == 2200
    save_json(str(tmp_path / "t.json"), {"pii": 1.5})
    assert load_json(str(tmp_path / "t.json")) == {"pii": 1.5} and mib(1048576) == "1.0 MiB"
    assert "| a | 0.500 |" in report(spark.createDataFrame([("a", 0.5)], "task string, f1 double"), "Metrics")
