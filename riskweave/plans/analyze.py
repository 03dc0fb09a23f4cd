"""The whole analysis of a table of texts: evidence, scores, confidence, decision record."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ACTIONS, METADATA_FLAGS, PII_TYPES, SECRET_TYPES, SEVERITIES, TASKS, Policy
from ..functions import evidence as ev
from ..functions import policy as rules
from ..functions import scoring as sc
from ..functions.text import normalize
from ..operators.heads import Heads, arrays, hashed_features, logits
from ..operators.wordpiece import encoded, encoder_window, wordpiece


def flags_of(df: DataFrame) -> dict[str, Column]:
    return {f: F.coalesce(F.col(f), F.lit(False)) for f in METADATA_FLAGS if f in df.columns}


def with_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the flags has_pii, has_secret and transfer without placing any span."""
    value = F.coalesce(F.col(text), F.lit(""))
    transfer = ev.occurs_any(value, ("EXTERNAL_TRANSFER",))
    if "external_api" in df.columns:
        transfer = transfer | F.coalesce(F.col("external_api"), F.lit(False))
    return df.withColumns({"has_pii": ev.occurs_any(value, PII_TYPES), "has_secret": ev.occurs_any(value, SECRET_TYPES), "transfer": transfer})


def with_evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds evidence and its flags; staged so that the patterns run once."""
    external = F.col("external_api") if "external_api" in df.columns else None
    df = df.withColumn("evidence", ev.evidence(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumns({"has_pii": ev.has_pii(F.col("evidence")), "has_secret": ev.has_secret(F.col("evidence")), "transfer": ev.has_transfer(F.col("evidence"), external)})


def rule_decisions(df: DataFrame, text: str = "text", policy: Policy = Policy()) -> DataFrame:
    """Decisions by evidence alone: a score of 1 for pii or secret where there is evidence, full confidence."""
    df = with_flags(df, text)
    scores = {t: F.lit(0.0) for t in TASKS} | {"pii": F.col("has_pii").cast("double"), "secret": F.col("has_secret").cast("double")}
    verdict = rules.decide(scores, F.col("has_pii"), F.col("has_secret"), F.col("transfer"), flags_of(df), policy=policy)
    return df.withColumn("verdict", verdict).withColumns({"action": F.col("verdict.action"), "policy_reason": F.col("verdict.reason")}).drop("verdict")


def decision_records(df: DataFrame, temperatures: dict[str, float] | None = None, policy: Policy = Policy()) -> DataFrame:
    """Full records from rows with has_pii, has_secret, transfer and the logit arrays risks (9), severity_logits and action_logits (4 each)."""
    temperatures = temperatures or {}
    raw = {t: sc.calibrated(sc.sigmoid(F.element_at("risks", i + 1)), F.lit(float(temperatures.get(t, 1.0)))) for i, t in enumerate(TASKS)}
    df = df.withColumns(raw)
    df = df.withColumns({"pii": sc.floored(F.col("pii"), F.col("has_pii")), "secret": sc.floored(F.col("secret"), F.col("has_secret")), "certainty": sc.confidence(F.col("severity_logits"), F.col("action_logits"))})
    verdict = rules.decide({t: F.col(t) for t in TASKS}, F.col("has_pii"), F.col("has_secret"), F.col("transfer"), flags_of(df), F.col("certainty"), policy)
    df = df.withColumn("verdict", verdict)
    return df.withColumns({
        "severity": sc.decoded(F.col("severity_logits"), SEVERITIES), "model_action": sc.decoded(F.col("action_logits"), ACTIONS), "action": F.col("verdict.action"), "policy_reason": F.col("verdict.reason"),
        "confidence": F.bround("certainty", 4), "abstain": F.col("verdict.reason") == "uncertain",
    }).drop("verdict", "certainty")


# A score provider adds risks (9), severity_logits and action_logits (4 each) to a table with the text column.
ScoreProvider = Callable[[DataFrame, str], DataFrame]
# Our own lexicon, in place of the encoder that isn't part of the repository: word beginnings that speak for each task.
LEXICON = {
    "pii": "address|phone|passport|email|customer", "secret": "password|secret|token|credential|api key", "prompt_injection": "ignore|override|reveal|system prompt|jailbreak", "dangerous_instruction": "explosive|weapon|malware|exploit|poison",
    "privacy_risk": "profil|track|surveil|personal", "security_risk": "attack|hack|breach|vulnerab|port ", "ethics_risk": "discriminat|manipulat|deceiv|harm", "oversight_risk": "unsupervised|without review|autonomous|approve", "data_governance_risk": "retention|transfer|consent|dataset",
}
MOST = 4  # occurrences of a task's words in a text that count


def _occurrences(text: Column, words: str) -> Column:
    """How often any of the words, which don't overlap each other, occurs: by what is left without them, as literals are found faster than patterns."""
    size = lambda t: F.octet_length(t)
    return sum(((size(text) - size(F.replace(text, F.lit(w), F.lit("")))) / len(w.encode()) for w in words.split("|")), F.lit(0.0))


def lexicon_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """A score provider of Catalyst expressions: logits linear in how often each task's words occur, up to MOST times each task.

    Texts are normalised first; the lexicon's words are plain, so a dotless i counts as i.
    """
    df = df.withColumn("_folded", F.replace(normalize(F.coalesce(F.col(text), F.lit(""))), F.lit("ı"), F.lit("i")))
    df = df.withColumn("_seen", F.array(*[F.least(_occurrences(F.col("_folded"), words), F.lit(float(MOST))) for words in LEXICON.values()]))
    of = lambda task: F.element_at("_seen", TASKS.index(task) + 1)
    total = F.least(F.aggregate("_seen", F.lit(0.0), lambda s, n: s + n), F.lit(6.0))
    severity = F.array(2 - total, 0.5 + 0.1 * total, 0.5 * total - 0.5, 0.8 * total - 2)
    action = F.array(2 - total, 0.9 * of("pii") - 1, 0.3 + 0.3 * total, 0.9 * (of("secret") + of("prompt_injection") + of("dangerous_instruction")) - 2)
    return df.withColumns({"risks": F.transform("_seen", lambda n: 1.5 * n - 2.5), "severity_logits": severity, "action_logits": action}).drop("_seen", "_folded")


EVIDENCE = ("evidence", "has_pii", "has_secret", "transfer")
SCORES = ("risks", "severity_logits", "action_logits")


def analyze(df: DataFrame, scores: ScoreProvider = lexicon_scores, temperatures: dict[str, float] | None = None, policy: Policy = Policy(), text: str = "text", distinct: bool = False) -> DataFrame:
    """From a text column and any of the metadata flags to the whole decision record: df's columns, then the record's.

    Texts are judged apart from the rows' other columns, so these stay whatever their names; one that the record has too is
    an error.  With `distinct` each different text is judged once, found by its digest, and joined back to all its rows:
    worth a shuffle where texts repeat or scores are dear.  Rows of a text that many share can be split in that join.
    """
    clash = sorted(c for c in df.columns if c.lower() in {r.lower() for r in (*RECORD, "has_pii", "has_secret", "transfer")})
    if clash:
        raise ValueError(f"columns that the record has too, to be renamed first: {', '.join(clash)}")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    flags = [c for f in METADATA_FLAGS for c in df.columns if c == f]
    rows = df.select(F.struct(*df.columns).alias("_row"), *flags, (F.sha2(value, 256) if distinct else value).alias("_text"))
    judged = lambda texts: scores(with_evidence(texts, "_text"), "_text")
    if distinct:
        texts = df.select(value.alias("_text")).select("_text", F.sha2("_text", 256).alias("_digest"), F.length("_text").alias("_n"))
        once = judged(texts.dropDuplicates(["_digest", "_n"]))  # dealt by both, so that the join deals both its sides and can split either
        rows = rows.withColumnRenamed("_text", "_digest").join(once.select("_digest", *EVIDENCE, *SCORES), "_digest")
    else:
        rows = judged(rows)
    if "external_api" in flags:
        rows = rows.withColumn("transfer", F.col("transfer") | F.coalesce(F.col("external_api"), F.lit(False)))
    told = decision_records(rows, temperatures, policy)
    return told.select("_row.*", *EVIDENCE[1:], *RECORD)


def trained_scores(heads: Heads) -> ScoreProvider:
    """A score provider of heads trained together (operators/heads.py) on hashed words: risks, severity and action."""

    def scores(df: DataFrame, text: str = "text") -> DataFrame:
        made = hashed_features(df, heads.weights.shape[1] - 1, text, "_features").withColumn("_logits", logits(F.col("_features"), heads.weights))
        return made.withColumns(arrays(F.col("_logits"))).drop("_features", "_logits")

    return scores


def encoded_scores(heads: Heads, vocabulary: DataFrame, length: int = 96) -> ScoreProvider:
    """A score provider of heads trained on encoded windows of word pieces (operators/wordpiece.py): tokens, encoder, pool, heads."""

    def scores(df: DataFrame, text: str = "text") -> DataFrame:
        made = wordpiece(df, vocabulary, text, "_ids", length - 2).withColumn("_window", encoder_window(F.col("_ids"), length))
        made = made.withColumn("_features", encoded(F.col("_window"), heads.weights.shape[1] - 1)).withColumn("_logits", logits(F.col("_features"), heads.weights))
        return made.withColumns(arrays(F.col("_logits"))).drop("_ids", "_window", "_features", "_logits")

    return scores


def head_scores(models: dict) -> ScoreProvider:
    """A score provider of trained heads (operators/surrogate.py, one for each task); severity and action follow the lexicon."""
    from ..operators.surrogate import score_heads

    def scores(df: DataFrame, text: str = "text") -> DataFrame:
        return score_heads(lexicon_scores(df, text), {t: models[t] for t in TASKS}, text)

    return scores


RECORD = (*TASKS, "severity", "model_action", "action", "policy_reason", "confidence", "abstain", "evidence")


def record_json(df: DataFrame) -> Column:
    """The decision record of a row as JSON, its fields in their fixed order."""
    return F.to_json(F.struct(*[F.col(c) for c in RECORD if c in df.columns]))


def analyze_text(spark: SparkSession, text: str | None, metadata: dict[str, bool] | None = None, **options) -> dict:
    """One text with its flags to one record, for interactive use."""
    given = {f: bool(v) for f, v in (metadata or {}).items() if f in METADATA_FLAGS}
    row = spark.createDataFrame([(text, *given.values())], ", ".join(["text string", *(f"{f} boolean" for f in given)]))
    done = analyze(row, **options)
    return json.loads(done.select(record_json(done)).first()[0])


def analyze_form(spark: SparkSession, text: str | None, agent: bool = False, shell: bool = False, filesystem: bool = False, network: bool = False, database: bool = False, external_api: bool = False, credential_access: bool = False, human_approval: bool = False, **options) -> tuple[str, dict]:
    """A text and eight flags to an HTML card and a record; blank texts give a note and no record, long ones are cut."""
    from ..functions.display import EMPTY, card
    from ..functions.text import MAX_CHARS

    text = (text or "")[:MAX_CHARS]
    if not text.strip():
        return EMPTY, {}
    flags = dict(agent=agent, shell=shell, filesystem=filesystem, network=network, database=database, external_api=external_api, credential_access=credential_access, human_approval=human_approval)
    record = analyze_text(spark, text, flags, **options)
    shown = record | {t: round(record[t], 4) for t in TASKS} | {"abstain": record["policy_reason"] == "uncertain"}
    return card(record), shown
