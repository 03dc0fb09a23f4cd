"""A decision record as an HTML card, and SQL functions for use in queries."""

from __future__ import annotations

import html

from pyspark.sql import SparkSession

from ..constants import TASKS, Policy
from .evidence import evidence_sql, tc_valid_sql
from .policy import DISPLAY, decide_sql

EMPTY = "<p>Enter a short text.</p>"


def card(record: dict, most: int = 12, width: int = 80) -> str:
    """Action, reason, severity, confidence, a bar for each risk and the first spans; all text is escaped."""
    bars = "".join(f"<li>{html.escape(t.replace('_', ' '))} <meter min=\"0\" max=\"100\" value=\"{record[t] * 100:.1f}\"></meter> {record[t]:.2f}</li>" for t in TASKS)
    spans = "".join(f"<li>{html.escape(s['type'])} · {html.escape(s['text'][:width])}</li>" for s in record.get("evidence", [])[:most]) or "<li>none</li>"
    reason = html.escape(DISPLAY.get(record["policy_reason"], record["policy_reason"]))
    head = f"<h2>{html.escape(record['action'])}</h2><p>{reason}</p><p>severity {html.escape(record['severity'])}, confidence {record['confidence']:.2f}</p>"
    return f"<article>{head}<h3>Risks</h3><ul>{bars}</ul><h3>Evidence</h3><ul>{spans}</ul></article>"


def register_functions(spark: SparkSession, policy: Policy = Policy()) -> None:
    """Session functions in SQL, which Catalyst inlines.

    normalize_text(t), tc_valid(v), decide(...) as 'ACTION/reason' by the policy, evidence_of(t) as an array of spans, and the
    table function evidence(t), a row (type, text, start, end) for each span: SELECT ... FROM docs, LATERAL evidence(docs.text).
    """
    function = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{function} normalize_text(t STRING) RETURNS STRING RETURN lower(replace(t, 'I', 'ı'))")
    spark.sql(f"{function} tc_valid(v STRING) RETURNS BOOLEAN RETURN {tc_valid_sql('v')}")
    names = ["prompt_injection", "dangerous_instruction", "secret", "pii", "highest", "confidence"]
    flags = ["has_pii", "has_secret", "transfer", "needs_approval"]
    spark.sql(f"{function} decide(" + ", ".join([*(f"{n} DOUBLE" for n in names), *(f"{f} BOOLEAN" for f in flags)]) + f") RETURNS STRING RETURN {decide_sql(policy)}")
    spans = evidence_sql("t")
    spark.sql(f"{function} evidence_of(t STRING) RETURNS ARRAY<STRUCT<type: STRING, text: STRING, start: INT, `end`: INT>> RETURN transform({spans}, s -> named_struct('type', s.type, 'text', s.text, 'start', s.start, 'end', s.end))")
    spark.sql(f"{function} evidence(t STRING) RETURNS TABLE (type STRING, text STRING, start INT, `end` INT) RETURN SELECT s.type, s.text, s.start, s.end FROM (SELECT explode({spans}) AS s)")
