import math

from pyspark.sql import functions as F

from riskweave.constants import Policy
from riskweave.functions import policy as rules
from riskweave.functions import scoring as sc
from riskweave.operators import metrics as mt
from riskweave.operators import synth, tuning
from riskweave.plans import catalogue

REASONS = {1: "secret_evidence", 2: "secret_evidence", 3: "pii_external_transfer", 4: "pii_external_transfer", 5: "uncertain", 6: "low_risk", 7: "prompt_injection", 8: "dangerous_instruction", 9: "unverified_secret_score", 10: "pii_external_transfer", 11: "agent_permissions", 12: "agent_permissions", 13: "low_risk", 14: "low_risk", 15: "elevated_risk", 16: "elevated_risk", 17: "low_risk"}


def test_each_rule_and_boundary(spark):
    got = {r["id"]: r["policy_reason"] for r in catalogue.FIXED["policy_cases"][0](spark, "").collect()}
    assert got == REASONS


def test_policy_file_overrides(tmp_path):
    (tmp_path / "p.yaml").write_text("pii: 0.5\nconfidence: 0.2\nother: 1\n")
    assert rules.read_policy(str(tmp_path / "p.yaml")) == Policy(pii=0.5, confidence=0.2)


def test_calibration_bins_keep_floating_edges(spark):
    p = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.9, 1.0)], "p double")
    assert [r[0] for r in p.select(mt.bin_index(F.col("p"))).collect()] == [0, 1, 2, 2, 5, 6, 9, 9]


def test_zero_division_and_single_class(spark):
    none = spark.createDataFrame([(0, 0.1, -1.0), (0, 0.2, -2.0)], "y int, p double, z double")
    row = mt.task_metrics(mt.with_prediction(none)).first()
    assert (row["precision"], row["recall"], row["f1"], row["false_positive_rate"], row["accuracy"]) == (0, 0, 0, 0, 1)
    assert tuning.temperature_grid(none).first()["temperature"] == 1.0


def test_temperature_and_ece_ranges(spark):
    df = spark.createDataFrame([(0, -4.0), (0, -2.0), (1, 2.0), (1, 4.0)], "y int, z double").withColumn("p", sc.sigmoid(F.col("z")))
    assert 0 < tuning.temperature_grid(df).first()[0] <= 10 and 0 <= mt.ece(df).first()[0] <= 1


def test_score_functions(spark):
    row = spark.range(1).select(sc.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))), sc.top_softmax(F.array(F.lit(0.0), F.lit(0.0))), sc.calibrated(F.lit(0.0), F.lit(None).cast("double")), sc.certainty(F.array(F.lit(0.5), F.lit(0.9)))).first()
    assert row[0] == 1 and row[1] == 0.5 and math.isclose(row[2], 1e-7, rel_tol=1e-6) and math.isclose(row[3], 0.8)


def test_ties_in_selection(spark):
    curve = spark.createDataFrame([(0.2, 0.5, 0.3), (0.1, 0.5, 0.3), (0.3, 0.5, 0.1), (0.4, 0.4, 0.0)], "threshold double, f1 double, fpr double")
    assert tuning.best_threshold(curve).first()["threshold"] == 0.3
    assert tuning.best_epoch(spark.createDataFrame([(3, 0.5), (2, 0.5)], "epoch int, validation_f1 double")).first()["epoch"] == 2


def test_families_are_disjoint_and_all_there(spark):
    df = synth.corpus(spark, 1100).withColumn("split", synth.split_of(F.col("family")))
    assert df.count() == 1100 and df.select("family").distinct().count() == 110 and synth.family_overlap(df).isEmpty()
    assert df.where("text LIKE '%{%'").isEmpty()


def test_latency_takes_the_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    row = mt.latency(df, "v").first()
    assert row["p50"] == 3.0 and row["n"] == 4
