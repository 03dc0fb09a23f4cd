"""Vocabularies and thresholds."""

from dataclasses import dataclass

# Tasks in logit order, actions and severities in rank order.
TASKS = ("pii", "secret", "prompt_injection", "dangerous_instruction", "privacy_risk", "security_risk", "ethics_risk", "oversight_risk", "data_governance_risk")
ACTIONS = ("ALLOW", "REDACT", "REVIEW", "BLOCK")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SECRET_TYPES = ("API_KEY", "BEARER", "PRIVATE_KEY", "GITHUB_TOKEN", "AWS_KEY", "PASSWORD", "DB_CREDENTIAL", "ENV_SECRET")
PII_TYPES = ("TC_KIMLIK", "EMAIL", "PHONE", "IP", "CARD", "IBAN", "ADDRESS", "NAME", "CUSTOMER_ID", "PII_MENTION")
METADATA_FLAGS = ("agent", "shell", "filesystem", "network", "database", "external_api", "credential_access", "human_approval")
ANY_RISK_TASKS = ("privacy_risk", "security_risk", "ethics_risk", "oversight_risk", "data_governance_risk")


@dataclass(frozen=True)
class Policy:
    """Thresholds of the decision rules; `elevated` is not configurable in policy files."""

    pii: float = 0.65
    secret: float = 0.65
    prompt_injection: float = 0.70
    dangerous_instruction: float = 0.75
    confidence: float = 0.60
    elevated: float = 0.70
