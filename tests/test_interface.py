import json

from pyspark.sql import functions as F

from riskweave.__main__ import main
from riskweave.constants import TASKS
from riskweave.functions import evidence as ev
from riskweave.functions.text import token_window
from riskweave.operators import synth
from riskweave.operators.surrogate import fit_heads, load_heads, save_heads
from riskweave.plans import analyze as an
from riskweave.sources import environment


def test_command_line(spark, capsys):
    main(["--text", "parola: gizli-deger", "--metadata", '{"agent": true}'], spark)
    record = json.loads(capsys.readouterr().out)
    assert list(record) == list(an.RECORD) and record["policy_reason"] == "secret_evidence"


def test_saved_heads_give_the_same_records(spark, tmp_path, capsys):
    rows = synth.corpus(spark, 660)
    heads = fit_heads(rows, TASKS, steps=3)
    save_heads(heads, str(tmp_path))
    text = rows.first().text
    given = an.analyze_text(spark, text, scores=an.head_scores(heads))
    main(["--text", text, "--backend", str(tmp_path)], spark)
    assert json.loads(capsys.readouterr().out) == given == an.analyze_text(spark, text, scores=an.head_scores(load_heads(str(tmp_path), TASKS)))
    assert any(abs(given[t] - an.analyze_text(spark, text)[t]) > 1e-6 for t in TASKS)


def test_one_head_alone(spark):
    rows = synth.corpus(spark, 440)
    assert list(fit_heads(rows, ("prompt_injection",), steps=10)) == ["prompt_injection"]


def test_token_window(spark):
    row = spark.sql("SELECT array(7, 8, 9) AS a, CAST(array() AS array<int>) AS b").select(token_window(F.col("a"), 2).alias("cut"), token_window(F.col("a"), 5, -1).alias("filled"), token_window(F.col("b"), 2).alias("none")).first()
    assert (row.cut.tokens, row.cut.mask) == ([7, 8], [1, 1])
    assert (row.filled.tokens, row.filled.mask) == ([7, 8, 9, -1, -1], [1, 1, 1, 0, 0])
    assert (row.none.tokens, row.none.mask) == ([0, 0], [0, 0])


def test_types_are_a_subset(spark):
    found = ev.evidence(F.lit("Reach bob@example.org, password=abc12345"))
    row = spark.range(1).select(*[ev.has_all_types(found, t).alias(f"c{i}") for i, t in enumerate([("EMAIL",), ("EMAIL", "PASSWORD"), ("EMAIL", "IBAN"), ()])]).first()
    assert tuple(row) == (True, True, False, True)


def test_environment(spark):
    page = environment(spark)
    assert f"| spark | {spark.version} |" in page and "| cores | 4 |" in page
