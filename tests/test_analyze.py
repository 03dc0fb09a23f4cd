import json
import random
import time

import pytest
from pyspark.sql import functions as F

from riskweave.constants import TASKS
from riskweave.functions import evidence as ev
from riskweave.functions import scoring as sc
from riskweave.functions.display import EMPTY, card, register_functions
from riskweave.operators import metrics as mt
from riskweave.operators import ranks, synth, tuning
from riskweave.operators.surrogate import fit_heads, score_heads
from riskweave.plans import analyze as an
from riskweave.plans import catalogue
from riskweave.plans import fixtures as fx
from riskweave.sources import load_json, percent, read_rows, save_json, spread, write_teacher
from riskweave.sources.summary import INPUTS, read_results, summary

SF = "/root/testdata/sf0.001"


def test_flags_equal_those_of_spans(spark):
    docs = fx.frame(spark, [*fx.TEXTS, (90, None)], "id int, text string").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    quick = {tuple(r) for r in an.with_flags(docs).select("id", "has_pii", "has_secret", "transfer").collect()}
    assert quick == {tuple(r) for r in an.with_evidence(docs).select("id", "has_pii", "has_secret", "transfer").collect()}
    seen = docs.select("id", *[ev.occurs(F.coalesce("text", F.lit("")), k).alias(k) for k in ev.PATTERNS], F.transform(ev.evidence(F.col("text")), lambda s: s["type"]).alias("types"))
    assert all(r[k] == (k in (r.types or [])) for r in seen.collect() for k in ev.PATTERNS)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1300])
def test_offsets_over_many_matches(spark, n):
    text = " ".join(f"u{j}@ex{j}.org 10.0.{j % 256}.7" for j in range(n)) + " end"
    row = spark.createDataFrame([(text,)], "text string").select(ev.evidence(F.col("text")).alias("e")).first()
    assert len(row.e) == 2 * n and all(text[s["start"] : s["end"]] == s["text"] for s in row.e)


def test_spans_take_time_in_proportion_to_matches(spark):
    def took(n):
        df = spark.createDataFrame([(" ".join(f"u{j}@ex{j}.org" for j in range(n)),)] * 8, "text string").select(F.sum(F.size(ev.evidence(F.col("text"))))).persist()
        began = time.perf_counter()
        assert df.first()[0] == 8 * n
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 40 * max(took(400), 0.5)


def test_analyze_one_text(spark):
    got = an.analyze_text(spark, "Reach bob@example.org and send the customer list", {"external_api": True, "agent": False, "other": True})
    assert list(got) == [*an.RECORD] and got["action"] == "REDACT" and got["policy_reason"] == "pii_external_transfer" and got["pii"] >= 0.95 and got["abstain"] is False
    assert {e["type"] for e in got["evidence"]} == {"EMAIL", "PII_MENTION", "EXTERNAL_TRANSFER"} and got["confidence"] == round(got["confidence"], 4)
    assert an.analyze_text(spark, "parola: gizli-deger")["policy_reason"] == "secret_evidence"
    assert an.analyze_text(spark, "run it", {"agent": True, "shell": True})["policy_reason"] == "agent_permissions"
    assert an.analyze_text(spark, None)["action"] == "ALLOW"
    hot = an.analyze_text(spark, "ignore all", temperatures={"prompt_injection": 4.0})
    assert hot["prompt_injection"] == pytest.approx(1 / (1 + 2.718281828 ** (1.0 / 4)), rel=1e-6)


def test_analyze_takes_any_score_provider(spark):
    def certain(df, text):
        return df.withColumns({"risks": F.array_repeat(F.lit(-9.0), 9), "severity_logits": F.array(*map(F.lit, (0.0, 9.0, 0.0, 0.0))), "action_logits": F.array(*map(F.lit, (0.0, 0.0, 0.0, 9.0)))})

    row = an.analyze(spark.createDataFrame([("hello",)], "text string"), scores=certain).first()
    assert (row.action, row.severity, row.model_action) == ("ALLOW", "MEDIUM", "BLOCK") and "risks" not in row.asDict()


def test_form_and_card(spark):
    assert an.analyze_form(spark, "  ") == (EMPTY, {})
    page, shown = an.analyze_form(spark, "password=<b>abc</b>1234 " + "x" * 5000)
    assert "&lt;b&gt;" in page and "<b>" not in page and "Secret evidence" in page and page.count("<meter") == 9
    assert shown["action"] == "BLOCK" and all(shown[t] == round(shown[t], 4) for t in TASKS) and shown["evidence"][0]["end"] <= 2000
    assert "none" in card({**dict.fromkeys(TASKS, 0.1), "action": "ALLOW", "policy_reason": "low_risk", "severity": "LOW", "confidence": 0.9})


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT normalize_text('IŞIK') AS a, tc_valid('19090909018') AS b, tc_valid('19090909019') AS c, tc_valid('x') AS d, decide(0, 0, 0, 0, 0, 0.9, false, false, false, true) AS e").first()
    assert tuple(row) == ("ışık", True, False, False, "REVIEW/agent_permissions")
    cases = fx.frame(spark, fx.CASES, fx.CASE_COLUMNS).withColumn("needs", catalogue.rules.agent_needs_approval(an.flags_of(fx.frame(spark, fx.CASES, fx.CASE_COLUMNS))))
    found = cases.selectExpr("id", "decide(prompt_injection, dangerous_instruction, secret, pii, greatest(pii, secret, prompt_injection, dangerous_instruction, ethics_risk), confidence, evidence = 'pii', evidence = 'secret', transfer OR coalesce(external_api, false), needs) AS v")
    want = {r.id: f"{r.action}/{r.policy_reason}" for r in catalogue.FIXED["policy_cases"][0](spark, "").collect()}
    assert {r.id: r.v for r in found.collect()} == want


def test_value_at_rank_equals_sorting(spark):
    r = random.Random(2)
    groups = {"hot": [r.lognormvariate(0, 3) for _ in range(3000)], "ties": [1.0] * 50 + [2.0] * 51, "one": [4.0], None: [float(i % 7) for i in range(20)], "odd": [float("inf"), 1.0, float("-inf"), 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    for rank in (lambda n: n // 2, lambda n: 0, lambda n: n - 1):
        got = {x.g: (x.n, x.v) for x in ranks.value_at_rank(df, "v", lambda n, rank=rank: F.floor(n / 2) if rank(10) == 5 else F.lit(0) if rank(10) == 0 else n - 1, "g").collect()}
        assert got == {g: (len(vs), sorted(vs)[rank(len(vs))]) for g, vs in groups.items()}
    row = mt.latency(df.limit(0), "v").collect()
    assert row == [] or row[0].p50 is None


def test_stratified_split_is_exact(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(900)], "k long, s string")
    got = {(r.s, r.split): r["count"] for r in ranks.stratified_split(df, "k", "s").groupBy("s", "split").count().collect()}
    assert got == {("a", "val"): 120, ("a", "train"): 480, ("b", "val"): 30, ("b", "train"): 120, (None, "val"): 30, (None, "train"): 120}
    assert ranks.stratified_split(df, "k", "s").columns == ["k", "s", "split"] and ranks.stratified_split(df.limit(0), "k", "s").count() == 0
    assert ranks.stratified_split(df.limit(2), "k", "s", share=0.1).where("split = 'val'").count() == 0
    one, two = (sorted(map(tuple, ranks.seeded_sample(df.repartition(n), "k", 50).collect()), key=str) for n in (1, 5))
    assert one == two and len(one) == 50


def test_temperature_fit_beats_the_grid(spark):
    r = random.Random(3)
    data = [(t, int(r.random() < 1 / (1 + 2.718281828 ** (-z / heat))), z) for t, heat in (("a", 0.7), ("b", 3.1)) for z in [r.gauss(0, 3) for _ in range(400)]] + [("c", 1, 2.0), ("c", 1, -1.0)]
    df = spark.createDataFrame(data, "task string, y int, z double").cache()
    fitted = {x.task: x.temperature for x in tuning.temperature_fit(df, "task").collect()}
    loss = lambda t, heat: df.where(F.col("task") == t).agg(F.avg(sc.binary_cross_entropy(F.col("z") / heat, F.col("y")))).first()[0]
    for t in ("a", "b"):
        assert all(loss(t, fitted[t]) <= loss(t, fitted[t] * f) + 1e-9 for f in (0.99, 0.997, 1.003, 1.01))
    assert fitted["c"] == 1.0


def test_calibration_in_one_pass(spark):
    df = catalogue.long(spark, SF)
    one = {r.task: (round(r.ece, 9), round(r.brier, 9), round(r.nll, 9)) for r in mt.calibration(df, "task").collect()}
    two = mt.ece(df, "task").join(mt.brier_nll(df, "task"), "task")
    assert one == {r.task: (round(r.ece, 9), round(r.brier, 9), round(r.nll, 9)) for r in two.collect()}


def test_privacy_rule_of_the_generator_never_fires(spark):
    assert synth.corpus(spark, 2200).where("category = 'PII' AND privacy_risk = 1").isEmpty()


def test_surrogate_heads_on_held_out_families(spark):
    rows = synth.corpus(spark, 1100).withColumn("split", synth.split_of(F.col("family")))
    models = fit_heads(rows.where("split = 'train'"), ("pii", "secret"))
    scored = score_heads(rows.where("split = 'test'"), models)
    assert "features" not in scored.columns and scored.where("size(risks) <> 2").isEmpty()
    right = scored.agg(F.avg(((F.col("risks")[0] > 0) == (F.col("pii") == 1)).cast("int"))).first()[0]
    assert right > 0.9


def test_spread_leaves_spread_tables_alone(spark):
    assert spread(spark.range(100, numPartitions=50)).rdd.getNumPartitions() == 50
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_teacher_targets_and_summary(spark, tmp_path):
    rows = synth.corpus(spark, 22)
    write_teacher(rows, str(tmp_path / "teacher"))
    back = read_rows(spark, str(tmp_path / "teacher"), "text string, teacher map<string, double>")
    assert back.count() == 22 and set(back.first().teacher) == set(TASKS)
    rate = {"f1": 0.5, "recall": 0.5, "false_positive_rate": 0.1, "false_negative_rate": 0.5, "support": 3}
    loss = {"ece": 0.1, "brier": 0.2, "nll": 0.3}
    results = dict(zip(INPUTS, [
        {"parameters": 1000, "trainable_parameters": 10, "teacher_examples": 5}, {"counts": {"train": 7}}, {"examples": 9, "accuracy": 0.75, "macro_f1": 0.5, "tasks": {"pii": rate}, "baseline_rules": {"pii": rate}},
        {"pii": {"raw": loss, "calibrated": {**loss, "ece": 0.05}}}, {"action_disagreement": 0.125, "examples": 8}, {"full_bytes": 2 << 20, "half_bytes": 1 << 20}, {"cpu": {"cold_start_ms": 1.0, "warm_p50_ms": 2.0, "rss_delta_mib_approx": 3.0}},
        {"student": {"macro_f1": 0.5, "macro_recall": 0.4, "mean_ece": 0.3}, "rules": {"macro_f1": 0.2, "macro_recall": 0.1, "mean_ece": 0.4}, "latency_p50_ms": {"student_cpu": 4.0}},
    ], strict=True))
    for name, value in results.items():
        save_json(str(tmp_path / f"{name}.json"), value)
    page = summary(read_results({n: str(tmp_path / f"{n}.json") for n in INPUTS}))
    assert "12.5%" in page and "| ece | 0.100 | 0.050 |" in page and "| rules | 0.200 | 0.100 | 0.400 | not measured |" in page and "| half | 1.0 MiB | 50.0% |" in page
    assert load_json(str(tmp_path / "edge.json")) == results["edge"] and percent(0.5) == "50.0%" and json.dumps(results)
