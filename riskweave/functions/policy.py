"""Ordered decision rules: the first that holds gives action and reason."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TASKS, Policy

# The reasons' display names.
DISPLAY = {
    "secret_evidence": "Secret evidence", "pii_external_transfer": "PII and external transfer", "uncertain": "Low decision confidence", "prompt_injection": "Prompt injection", "dangerous_instruction": "Dangerous instruction",
    "unverified_secret_score": "Unverified secret score", "agent_permissions": "Agent permissions need approval", "elevated_risk": "Elevated risk", "low_risk": "Low risk",
}


def agent_needs_approval(flags: dict[str, Column]) -> Column:
    on = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    flag = lambda k: on.get(k, F.lit(False))
    return flag("agent") & (flag("shell") | flag("credential_access") | (flag("database") & flag("network"))) & ~flag("human_approval")


def abstains(confidence: Column, policy: Policy = Policy()) -> Column:
    return confidence < policy.confidence


class Sql(str):
    """A SQL condition or value as text, which combines as columns do, so that rules can be written once for both."""

    def __and__(self, other: Sql) -> Sql:
        return Sql(f"({self} AND {other})")

    def __or__(self, other: Sql) -> Sql:
        return Sql(f"({self} OR {other})")

    def __lt__(self, value: float) -> Sql:
        return Sql(f"({self} < {value!r}D)")

    def __ge__(self, value: float) -> Sql:
        return Sql(f"({self} >= {value!r}D)")


def _rules(score: dict, pii, secret, transfer, needs_approval, highest, confidence, policy: Policy) -> list[tuple]:
    """(condition, action, reason) in order, of columns or of SQL texts."""
    return [
        (secret, "BLOCK", "secret_evidence"),
        (pii & transfer, "REDACT", "pii_external_transfer"),
        (abstains(confidence, policy), "REVIEW", "uncertain"),
        (score["prompt_injection"] >= policy.prompt_injection, "BLOCK", "prompt_injection"),
        (score["dangerous_instruction"] >= policy.dangerous_instruction, "BLOCK", "dangerous_instruction"),
        (score["secret"] >= policy.secret, "REVIEW", "unverified_secret_score"),
        ((score["pii"] >= policy.pii) & transfer, "REDACT", "pii_external_transfer"),
        (needs_approval, "REVIEW", "agent_permissions"),
        ((highest >= policy.elevated) | pii, "REVIEW", "elevated_risk"),
    ]


def decide(scores: dict[str, Column], pii: Column, secret: Column, transfer: Column, flags: dict[str, Column] | None = None, confidence: Column | None = None, policy: Policy = Policy()) -> Column:
    """struct<action, reason>; transfer already includes the external_api flag."""
    confidence = F.lit(1.0) if confidence is None else confidence
    verdict = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    chain = F
    for condition, action, reason in _rules(scores, pii, secret, transfer, agent_needs_approval(flags or {}), F.greatest(*[scores[t] for t in TASKS]), confidence, policy):
        chain = chain.when(condition, verdict(action, reason))
    return chain.otherwise(verdict("ALLOW", "low_risk"))


def decide_sql(policy: Policy = Policy()) -> str:
    """The same rules as a SQL expression 'ACTION/reason' over prompt_injection, dangerous_instruction, secret, pii, highest, confidence, has_pii, has_secret, transfer and needs_approval."""
    named = {t: Sql(t) for t in ("prompt_injection", "dangerous_instruction", "secret", "pii")}
    rules = _rules(named, Sql("has_pii"), Sql("has_secret"), Sql("transfer"), Sql("needs_approval"), Sql("highest"), Sql("confidence"), policy)
    return "CASE " + " ".join(f"WHEN {condition} THEN '{action}/{reason}'" for condition, action, reason in rules) + " ELSE 'ALLOW/low_risk' END"


def display_reason(reason: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return names[reason]


def read_policy(path: str) -> Policy:
    """Thresholds from a YAML file of `name: number` lines; other names are ignored, as are missing ones."""
    import yaml

    with open(path) as file:
        stored = yaml.safe_load(file) or {}
    return Policy(**{f.name: float(stored[f.name]) for f in fields(Policy) if f.name in stored and f.name != "elevated"})
