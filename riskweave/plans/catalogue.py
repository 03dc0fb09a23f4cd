"""One query for each operator, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ACTIONS, ANY_RISK_TASKS, SEVERITIES, TASKS
from ..functions import evidence as ev
from ..functions import policy as rules
from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.display import register_functions
from ..operators import metrics as mt
from ..operators import heads as hd
from ..operators import ranks, synth, tuning, windows
from ..operators import wordpiece as wp
from ..sources import METADATA, concatenated, read_table, spread
from . import fixtures as fx
from . import oracles as o
from .analyze import LEXICON, MOST, analyze, decision_records, flags_of, rule_decisions, trained_scores, with_flags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FIXED: dict[str, tuple[Query, str]] = {}  # cases written out here, which the tests compare with SQL; they read no table


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def fixed(name: str, sql: str):
    def register(f: Query) -> Query:
        FIXED[name] = f, sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents, a note for each of them that holds one of the inline fixture's texts, and, with ids from -1 on down, that fixture."""
    inline = fx.frame(spark, fx.TEXTS, "id bigint, text string").select((-F.col("id")).alias("id"), "text")
    whole = spread(docs(spark, d).select("doc_id", "text"))
    held = F.element_at(F.array(*[F.lit(t) for _, t in fx.TEXTS]), (F.pmod("doc_id", F.lit(len(fx.TEXTS))) + 1).cast("int"))
    note = F.struct((-1000 - F.col("doc_id")).alias("id"), F.concat(F.lit("note "), F.col("doc_id").cast("string"), F.lit(": "), held).alias("text"))
    return inline.union(whole.select(F.inline(F.array(F.struct(F.col("doc_id").alias("id"), "text"), note))))


# --- scans, projections -------------------------------------------------------------------------------------------------
@query("scan_documents", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang, source")
def scan_documents(spark, d):
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("concat_sources", "SELECT origin, count(*) AS n, count(id) AS named, sum(length(text)) AS chars, count(role) AS with_role FROM (SELECT 'documents' AS origin, doc_id AS id, text, NULL AS role FROM documents UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark UNION ALL SELECT 'conversations', conv_id, text, role FROM conversations) GROUP BY origin")
def concat_sources(spark, d):
    """Three tables' texts as one, by origin; columns that a table lacks are null."""
    tables = {"documents": docs(spark, d).selectExpr("doc_id AS id", "text"), "benchmark": read_table(spark, d, "benchmark").selectExpr("item_id AS id", "text"), "conversations": read_table(spark, d, "conversations").selectExpr("conv_id AS id", "text", "role")}
    return concatenated(**tables).groupBy("origin").agg(F.count("*").alias("n"), F.count("id").alias("named"), F.sum(F.length("text")).alias("chars"), F.count("role").alias("with_role"))


@query("normalize_text", "SELECT doc_id, md5(lower(replace(replace(text, 'I', 'ı'), 'İ', 'i' || chr(775)))) AS digest FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@query("normalize_lang_aware", "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') THEN lower(replace(replace(text, 'I', 'ı'), 'İ', 'i')) ELSE lower(text) END) AS digest FROM documents")
def normalize_lang_aware(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.normalize_by_language(F.col("text"))).alias("digest"))


@query("text_guard", "SELECT conv_id, turn, length(substr(text, 1, 2000)) AS n FROM conversations WHERE NOT regexp_full_match(substr(text, 1, 2000), '\\s*')")
def text_guard(spark, d):
    cut = read_table(spark, d, "conversations").withColumn("cut", tx.guard(F.col("text")))
    return cut.where("cut IS NOT NULL").select("conv_id", "turn", F.length("cut").cast("bigint").alias("n"))


@query("token_window", "WITH w AS (SELECT doc_id, [CAST(length(x) AS INTEGER) for x in string_split(coalesce(text, ''), ' ')[1:96]] AS ids FROM documents) SELECT doc_id, array_to_string(list_resize(ids, 96, 0), ',') AS ids, CAST(len(ids) AS BIGINT) AS n FROM w")
def token_window(spark, d):
    """Windows of 96 tokens, with the lengths of words in place of vocabulary ids."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " ", 97), F.length)
    window = docs(spark, d).select("doc_id", tx.token_window(ids).alias("w"))
    return window.select("doc_id", F.array_join(F.col("w.tokens").cast("array<string>"), ",").alias("ids"), F.aggregate("w.mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("n"))


_PIECES = 20_000


def tokenized(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """Documents with ids, the first `most` or all, by a vocabulary of the pieces of all texts."""
    rows = spread(docs(spark, d).select("doc_id", "text"))
    return wp.wordpiece(rows, wp.induced_vocabulary(rows, _PIECES), most=most).drop("text")


@query("wordpiece_vocabulary", f"WITH RECURSIVE {o.wordpieces(_PIECES)} SELECT piece, id FROM vocab")
def wordpiece_vocabulary(spark, d):
    return wp.induced_vocabulary(spread(docs(spark, d).select("text")), _PIECES)


@query("wordpiece_ids", f"WITH RECURSIVE {o.wordpieces(_PIECES)} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM tokens")
def wordpiece_ids(spark, d):
    """Ids of every whole text by longest match from the left."""
    return tokenized(spark, d).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query("encoder_window", f"WITH RECURSIVE {o.wordpieces(_PIECES)}, cut AS (SELECT doc_id, list_concat(list_concat([2], ids[1:94]), [3]) AS ids FROM tokens) SELECT doc_id, array_to_string(list_resize(ids, 96, 0), ',') AS ids, CAST(len(ids) AS BIGINT) AS n FROM cut")
def encoder_window(spark, d):
    """An encoder's input of 96 ids from the ids of each text."""
    window = tokenized(spark, d, 94).select("doc_id", wp.encoder_window(F.col("ids")).alias("w"))
    return window.select("doc_id", F.array_join(F.col("w.tokens").cast("array<string>"), ",").alias("ids"), F.aggregate("w.mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("n"))


@query("encoder_states", f"WITH RECURSIVE {o.wordpieces(_PIECES)}, cut AS (SELECT doc_id, list_concat(list_concat([2], ids[1:94]), [3]) AS ids FROM tokens), each AS (SELECT doc_id, CAST(unnest(ids) AS BIGINT) + 1 AS t FROM cut) SELECT doc_id, CAST(k AS INT) AS k, round(avg((t * 7919 + (k + 1) * 104729 + t * (k + 1) * 1299709) % 2001 - 1000), 6) AS pooled FROM each, range(8) AS r(k) GROUP BY doc_id, k")
def encoder_states(spark, d):
    """Each text's window of tokens embedded and pooled under its mask, in thousandths."""
    window = tokenized(spark, d, 94).select("doc_id", wp.encoder_window(F.col("ids")).alias("w"))
    return rounded(window.select("doc_id", F.posexplode(wp.encoded(F.col("w"), 8)).alias("k", "pooled")).withColumn("pooled", F.col("pooled") * 1000))


@query("distinct_languages", "SELECT DISTINCT lang FROM documents ORDER BY lang")
def distinct_languages(spark, d):
    return docs(spark, d).select("lang").distinct().orderBy("lang")


@query("source_distribution", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_distribution(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("head_limit", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 256")
def head_limit(spark, d):
    return docs(spark, d).orderBy("doc_id").limit(256).select("doc_id", "n_chars")


_HASHED = "CAST(CAST('0x' || substr(md5(doc_id || '-42'), 1, 13) AS BIGINT) AS DOUBLE)"


@query("seeded_sample", f"SELECT doc_id, lang FROM documents ORDER BY {_HASHED}, doc_id LIMIT 2000")
def seeded_sample(spark, d):
    """2,000 rows, or all if fewer, in a hash order of the seed."""
    return ranks.seeded_sample(docs(spark, d).select("doc_id", "lang"), "doc_id", 2000)


@query("stratified_split", f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_HASHED}, doc_id) <= round(0.2 * count(*) OVER (PARTITION BY lang)) THEN 'val' ELSE 'train' END AS split FROM documents")
def stratified_split(spark, d):
    """A fifth of each language for validation, by hash order of id and seed."""
    return ranks.stratified_split(docs(spark, d).select("doc_id", "lang"), "doc_id", "lang")


@query("shuffled_positions", f"SELECT doc_id, row_number() OVER (ORDER BY {_HASHED}, doc_id) - 1 AS position FROM documents")
def shuffled_positions(spark, d):
    """Every document's place in the seeded shuffle of all."""
    return ranks.shuffled_positions(docs(spark, d).select("doc_id"), "doc_id")


@query("disjoint_subset", "SELECT CAST(count(*) AS BIGINT) AS missing FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def disjoint_subset(spark, d):
    """How many labels name no document: 0 where they are a subset."""
    return read_table(spark, d, "labels").join(docs(spark, d).select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))


_INCIDENTS = "incidents AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN source END AS title, CASE WHEN doc_id % 7 > 0 THEN text END AS description, CASE WHEN n_chars % 2 = 0 THEN 'reviewed' ELSE 'draft' END AS tier, CASE WHEN lang = 'en' THEN 'real-world' ELSE 'lab' END AS category, source AS corpus FROM documents)"


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as incident reports, some without a title or a description."""
    given = {"id": "doc_id", "title": "CASE WHEN doc_id % 5 > 0 THEN source END", "description": "CASE WHEN doc_id % 7 > 0 THEN text END", "tier": "IF(n_chars % 2 = 0, 'reviewed', 'draft')", "category": "IF(lang = 'en', 'real-world', 'lab')", "corpus": "source"}
    return docs(spark, d).selectExpr(*[f"{x} AS {n}" for n, x in given.items()])


@query("null_concat", f"WITH {_INCIDENTS} SELECT id, md5(coalesce(title, '') || '. ' || coalesce(description, '')) AS text FROM incidents")
def null_concat(spark, d):
    return incidents(spark, d).select("id", F.md5(tx.joined_title(F.col("title"), F.col("description"))).alias("text"))


@query("filter_reviewed", f"WITH {_INCIDENTS} SELECT corpus, count(*) AS n FROM incidents WHERE tier = 'reviewed' AND category = 'real-world' GROUP BY corpus")
def filter_reviewed(spark, d):
    return incidents(spark, d).where("tier = 'reviewed' AND category = 'real-world'").groupBy("corpus").agg(F.count("*").alias("n"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("inline_metadata", f"SELECT event_id, {_K} % 2 = 0 AS agent, {_K} % 3 = 1 AS external_api FROM events")
def inline_metadata(spark, d):
    """Flags from JSON objects, here made from the events' own; an absent flag is false."""
    k = F.get_json_object("props", "$.k").cast("long")
    sent = F.concat(F.lit('{"agent": '), (k % 2 == 0).cast("string"), F.when(k % 3 > 0, F.concat(F.lit(', "external_api": '), (k % 3 == 1).cast("string"))).otherwise(F.lit("")), F.lit("}"))
    parsed = read_table(spark, d, "events").select("event_id", F.from_json(sent, METADATA).alias("m"))
    return parsed.select("event_id", F.coalesce("m.agent", F.lit(False)).alias("agent"), F.coalesce("m.external_api", F.lit(False)).alias("external_api"))


@query("teacher_questions", "SELECT vec_id, task_id, 'Does this text contain ' || replace(task, '_', ' ') || '?' AS question FROM embeddings, (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TASKS)) + ") AS t(task_id, task)")
def teacher_questions(spark, d):
    """What a teacher is asked about each row, a question for each task."""
    tasks = F.posexplode(F.array(*map(F.lit, TASKS))).alias("task_id", "task")
    asked = read_table(spark, d, "embeddings").select("vec_id", tasks)
    return asked.select("vec_id", "task_id", F.concat(F.lit("Does this text contain "), F.replace("task", F.lit("_"), F.lit(" ")), F.lit("?")).alias("question"))


# --- evidence -----------------------------------------------------------------------------------------------------------
def _spans(kinds: tuple[str, ...]) -> Query:
    def run(spark, d):
        return texts(spark, d).select("id", F.inline(ev.evidence(F.col("text"), kinds))).select("id", "type", "text", "start", "end")

    return run


for _kind in ev.PATTERNS:
    query(f"ev_{_kind.lower()}", f'WITH {o.SRC} SELECT id, type, text, start, "end" FROM ({o.spans(_kind)})')(_spans((_kind,)))
query("ev_spans_all", f'WITH {o.SRC}, {o.ALL} SELECT id, type, text, start, "end" FROM spans')(_spans(tuple(ev.PATTERNS)))


@query("evidence_lateral", f'WITH {o.SRC}, {o.ALL} SELECT id, type, text, start, "end" FROM spans')
def evidence_lateral(spark, d):
    """The spans of all detectors by the SQL table function."""
    register_functions(spark)
    texts(spark, d).createOrReplaceTempView("_evidence_texts")
    return spark.sql("SELECT t.id, e.type, e.text, e.start, e.end FROM _evidence_texts AS t, LATERAL evidence(t.text) AS e")


@query("ip_valid", f"SELECT doc_id, v, {o.ip('v')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')) AS v FROM documents)")
def ip_valid(spark, d):
    """Which of the documents' dotted quads are addresses."""
    quads = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"), F.lit(0))).alias("v")
    return docs(spark, d).select("doc_id", quads).select("doc_id", "v", ev.is_ip(F.col("v")).alias("valid"))


@query("luhn_valid", f"SELECT doc_id, v, {o.luhn('v')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS v FROM documents)")
def luhn_valid(spark, d):
    """Which of the documents' long digit runs are card numbers."""
    digits = F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("v")
    return docs(spark, d).select("doc_id", digits).select("doc_id", "v", ev.is_card(F.col("v")).alias("valid"))


@query("tc_valid", f"SELECT id, {o.tc('v')} AS valid FROM (SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 19090909018 ELSE 10000000000 + o_orderkey * 7919 % 80000000000 END AS VARCHAR) AS v FROM orders)")
def tc_valid(spark, d):
    """Which eleven digits made from the orders' keys have right check digits."""
    key = F.col("o_orderkey").cast("long")
    v = F.when(key % 2 == 0, F.lit(19090909018)).otherwise(10_000_000_000 + key * 7919 % 80_000_000_000).cast("string")
    return read_table(spark, d, "orders").select(key.alias("id"), ev.is_national_id(v).alias("valid"))


@fixed("ip_cases", f"WITH v AS (SELECT v FROM (VALUES ('10.0.0.7'), ('300.1.1.1'), ('01.2.3.4'), ('255.255.255.255'), ('1.2.3.0')) AS t(v)) SELECT v, {o.ip('v')} AS valid FROM v")
def ip_cases(spark, d):
    return fx.frame(spark, [(v,) for v in ("10.0.0.7", "300.1.1.1", "01.2.3.4", "255.255.255.255", "1.2.3.0")], "v string").select("v", ev.is_ip(F.col("v")).alias("valid"))


_LUHN = ("4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "0000000000000", "123")


@fixed("luhn_cases", f"SELECT v, {o.luhn('v')} AS valid FROM {fx.values([(v,) for v in _LUHN], 'v')}")
def luhn_cases(spark, d):
    return fx.frame(spark, [(v,) for v in _LUHN], "v string").select("v", ev.is_card(F.col("v")).alias("valid"))


@fixed("tc_cases", f"WITH v AS (SELECT CAST(CASE WHEN id % 2 = 0 THEN 19090909018 ELSE 10000000000 + id * 7919 END AS VARCHAR) AS v, id FROM range(500) AS r(id)) SELECT id, {o.tc('v')} AS valid FROM v")
def tc_cases(spark, d):
    v = F.when(F.col("id") % 2 == 0, F.lit(19090909018)).otherwise(10_000_000_000 + F.col("id") * 7919).cast("string")
    return spark.range(500).select("id", ev.is_national_id(v).alias("valid"))


@query("evidence_flags", f"WITH {o.SRC}, {o.ALL}, {o.FLAGS} SELECT * FROM flags")
def evidence_flags(spark, d):
    return with_flags(texts(spark, d)).select("id", "has_pii", "has_secret", "transfer")


@query("evidence_chips", f"WITH {o.SRC}, {o.ALL} SELECT id, string_agg(type || ' · ' || substr(text, 1, 80), '|' ORDER BY start, \"end\", n) AS chips FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, \"end\", n) AS rn FROM spans) WHERE rn <= 12 GROUP BY id")
def evidence_chips(spark, d):
    labels = F.array_join(ev.chips(ev.evidence(F.col("text"))), "|")
    return texts(spark, d).select("id", F.explode(F.filter(F.array(labels), lambda c: c != "")).alias("chips"))  # a condition on an alias would make the evidence twice


@query("policy_reason_counts", f"WITH {o.SRC}, {o.ALL}, {o.FLAGS} SELECT split_part(v, '/', 1) AS action, split_part(v, '/', 2) AS policy_reason, count(*) AS n FROM (SELECT {o.RULES} AS v FROM flags) GROUP BY ALL")
def policy_reason_counts(spark, d):
    return rule_decisions(texts(spark, d)).groupBy("action", "policy_reason").agg(F.count("*").alias("n"))


@query("rule_baseline", f"WITH {o.SRC}, {o.ALL}, {o.FLAGS}, b AS (SELECT f.*, l.toxic AS y1 FROM flags f JOIN labels l ON f.id = l.doc_id), m AS (SELECT 'pii' AS task, y1 AS y, CAST(has_pii AS DOUBLE) AS p FROM b UNION ALL SELECT 'secret', y1, CAST(has_secret AS DOUBLE) FROM b) SELECT task, {o.RATE_LIST}, tp + fn AS support FROM ({o.counted('m', 'task')})")
def rule_baseline(spark, d):
    """Flags of the labelled documents against the one risk label that the table has; rule_baseline_synthetic has each task's own."""
    flagged = with_flags(spread(docs(spark, d).select("doc_id", "text"))).join(read_table(spark, d, "labels"), "doc_id")
    return baseline(flagged, {"pii": "toxic", "secret": "toxic"})


def baseline(flagged: DataFrame, truth: dict[str, str]) -> DataFrame:
    """Metrics of has_<task> as a score of 0 or 1 for the truth column of each task."""
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), F.col(y).cast("int").alias("y"), F.col(f"has_{t}").cast("double").alias("p")) for t, y in truth.items()])
    return rounded(mt.task_metrics(mt.with_prediction(flagged.select(F.inline(pairs))), "task"))


@query("benign_fpr", f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {o.ALL}, {o.FLAGS} SELECT count(*) AS n, count(*) FILTER (has_pii OR has_secret) AS false_positives, round(avg(CAST(has_pii OR has_secret AS INT)), 6) AS false_positive_rate FROM flags")
def benign_fpr(spark, d):
    hit = F.col("has_pii") | F.col("has_secret")
    flagged = with_flags(spread(read_table(spark, d, "benchmark").select("text")))
    return rounded(flagged.agg(F.count("*").alias("n"), F.count_if(hit).alias("false_positives"), F.avg(hit.cast("int")).alias("false_positive_rate")))


_VARIANT = "SELECT '{v}' AS variant, avg(CAST(regexp_matches({t}, 'i') AS INT)) AS share FROM documents"


@query("normalization_compare", "SELECT variant, round(share, 6) AS share FROM (" + " UNION ALL ".join(_VARIANT.format(v=v, t=t) for v, t in (("original", "lower(replace(text, 'I', 'ı'))"), ("language_aware", "CASE WHEN regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') THEN lower(replace(replace(text, 'I', 'ı'), 'İ', 'i')) ELSE lower(text) END"))) + ")")
def normalization_compare(spark, d):
    """A rule's hit rate under each normaliser; both are applied in one scan."""
    t = F.col("text")
    both = F.array(F.struct(F.lit("original").alias("variant"), tx.normalize(t).alias("t")), F.struct(F.lit("language_aware").alias("variant"), tx.normalize_by_language(t).alias("t")))
    return rounded(docs(spark, d).select(F.inline(both)).groupBy("variant").agg(F.avg(F.contains("t", F.lit("i")).cast("int")).alias("share")))


# --- policy on inline cases -----------------------------------------------------------------------------------------------
_C = fx.values(fx.CASES, "id, pii, secret, prompt_injection, dangerous_instruction, ethics_risk, confidence, evidence, transfer, agent, shell, database, network, human_approval, external_api")
_AGENT = "coalesce(agent, false) AND (coalesce(shell, false) OR (coalesce(database, false) AND coalesce(network, false))) AND NOT coalesce(human_approval, false)"
_T = "(transfer OR coalesce(external_api, false))"
_DECIDE = f"""CASE WHEN evidence = 'secret' THEN 'BLOCK/secret_evidence' WHEN evidence = 'pii' AND {_T} THEN 'REDACT/pii_external_transfer' WHEN confidence < CAST(0.6 AS DOUBLE) THEN 'REVIEW/uncertain'
WHEN prompt_injection >= CAST(0.7 AS DOUBLE) THEN 'BLOCK/prompt_injection' WHEN dangerous_instruction >= CAST(0.75 AS DOUBLE) THEN 'BLOCK/dangerous_instruction' WHEN secret >= CAST(0.65 AS DOUBLE) THEN 'REVIEW/unverified_secret_score'
WHEN pii >= CAST(0.65 AS DOUBLE) AND {_T} THEN 'REDACT/pii_external_transfer' WHEN {_AGENT} THEN 'REVIEW/agent_permissions' WHEN greatest(pii, secret, prompt_injection, dangerous_instruction, ethics_risk) >= CAST(0.7 AS DOUBLE) OR evidence = 'pii' THEN 'REVIEW/elevated_risk' ELSE 'ALLOW/low_risk' END"""


_SHARES = {"pii": 7, "secret": 13, "prompt_injection": 29, "dangerous_instruction": 31, "ethics_risk": 37, "confidence": 17}
_ROW_CASES = "(SELECT vec_id AS id, " + ", ".join(f"CAST(vec_id * {m} % 101 AS DOUBLE) / 100 AS {n}" for n, m in _SHARES.items()) + ", CASE label % 5 WHEN 0 THEN 'secret' WHEN 1 THEN 'pii' ELSE 'none' END AS evidence, vec_id % 3 = 0 AS transfer, vec_id % 4 < 3 AS agent, vec_id % 2 = 0 AS shell, vec_id % 7 < 4 AS database, vec_id % 5 < 3 AS network, vec_id % 11 < 2 AS human_approval, vec_id % 13 = 0 AS external_api FROM embeddings)"


def row_cases(spark: SparkSession, d: str) -> DataFrame:
    """A case for each vector: scores, confidence, evidence and flags that follow its number and label."""
    share = lambda m: (F.col("vec_id") * m % 101).cast("double") / 100
    flags = {"transfer": "vec_id % 3 = 0", "agent": "vec_id % 4 < 3", "shell": "vec_id % 2 = 0", "database": "vec_id % 7 < 4", "network": "vec_id % 5 < 3", "human_approval": "vec_id % 11 < 2", "external_api": "vec_id % 13 = 0"}
    kind = F.when(F.col("label") % 5 == 0, "secret").when(F.col("label") % 5 == 1, "pii").otherwise("none")
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[share(m).alias(n) for n, m in _SHARES.items()], kind.alias("evidence"), *[F.expr(x).alias(n) for n, x in flags.items()])


def decided(cases: DataFrame) -> DataFrame:
    scores = {t: F.col(t) if t in cases.columns else F.lit(0.01) for t in TASKS}
    transfer = F.col("transfer") | F.coalesce("external_api", F.lit(False))
    verdict = rules.decide(scores, F.col("evidence") == "pii", F.col("evidence") == "secret", transfer, flags_of(cases), F.col("confidence"))
    return cases.select("id", verdict.alias("v")).select("id", F.col("v.action").alias("action"), F.col("v.reason").alias("policy_reason"))


_DECIDED = f"SELECT id, split_part(v, '/', 1) AS action, split_part(v, '/', 2) AS policy_reason FROM (SELECT id, {_DECIDE} AS v FROM "


@query("policy_decide", f"{_DECIDED}{_ROW_CASES})")
def policy_decide(spark, d):
    return decided(row_cases(spark, d))


@fixed("policy_cases", f"{_DECIDED}{_C})")
def policy_cases(spark, d):
    return decided(fx.frame(spark, fx.CASES, fx.CASE_COLUMNS))


@query("agent_permissions", f"SELECT id, {_AGENT} AS needs_approval FROM {_ROW_CASES}")
def agent_permissions(spark, d):
    cases = row_cases(spark, d)
    return cases.select("id", rules.agent_needs_approval(flags_of(cases)).alias("needs_approval"))


# --- scores over embeddings -----------------------------------------------------------------------------------------------
def long(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, task_id, task, z, z1 (a second backend), t, p (calibrated) and y by fixed weights and temperatures."""
    return heads(read_table(spark, d, "embeddings"))


def heads(vectors: DataFrame, *keep: str) -> DataFrame:
    base = vectors.select("vec_id", "label", *keep, "embedding", F.posexplode(F.array(*map(F.lit, TASKS))).alias("task_id", "task"))
    head = lambda a, b, m, c: sc.linear(F.col("embedding"), lambda k: ((F.col("task_id") + a) * (k + b)) % m - c)
    base = base.withColumns({"z": head(1, 3, 7, 3), "z1": head(2, 5, 5, 2), "t": 0.5 + 0.25 * F.col("task_id"), "y": F.when((F.col("label") + F.col("task_id")) % 2 == 0, 1).otherwise(0)}).drop("embedding")
    return base.withColumn("p", sc.calibrated(sc.sigmoid(F.col("z")), F.col("t")))


def logits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "label", *[c.alias(n) for n, c in logits_of(F.col("embedding")).items()])


def logits_of(x: Column) -> dict[str, Column]:
    rows = lambda a, b: F.array(*[sc.linear(x, lambda k, j=j: ((j + a) * (k + b)) % 5 - 2) for j in range(4)])
    risks = F.array(*[sc.linear(x, lambda k, t=t: ((t + 1) * (k + 3)) % 7 - 3) for t in range(9)])
    return {"risks": risks, "severity_logits": rows(2, 5), "action_logits": rows(3, 1)}


H = f"WITH {o.HEADS} "
HL = f"WITH {o.HEADS}, {o.LOGITS} "


@query("mean_pool", "SELECT label, CAST(k - 1 AS INT) AS k, round(sum(v) / greatest(1, count(*)), 6) AS pooled FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k")
def mean_pool(spark, d):
    """Mean vector of each label; a vector is one row of the aggregation, whose positions are averaged side by side."""
    width = 64
    means = F.array(*[F.avg(F.get("embedding", k).cast("double")) for k in range(width)])
    return rounded(read_table(spark, d, "embeddings").groupBy("label").agg(means.alias("m")).select("label", F.posexplode("m").alias("k", "pooled")).where("pooled IS NOT NULL"))


@query("masked_pool", f"WITH m AS (SELECT vec_id, 1 + vec_id % 8 AS n, [[CAST(x AS DOUBLE) for x in embedding[8 * i + 1:8 * i + 8]] for i in range(8)] AS t FROM embeddings) SELECT vec_id, CAST(k - 1 AS INT) AS k, round(list_sum([t[i][k] for i in range(1, n + 1)]) / greatest(1, n), 6) AS pooled FROM (SELECT *, unnest(range(1, 9)) AS k FROM m)")
def masked_pool(spark, d):
    """Each vector as a matrix of eight tokens by eight, of which the mask keeps the first 1 to 8."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", 8 * i + 1, 8), lambda x: x.cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.pmod(F.col("vec_id"), F.lit(8))).cast("int"))
    pooled = read_table(spark, d, "embeddings").select("vec_id", tokens.alias("t"), mask.alias("m")).select("vec_id", F.posexplode(sc.masked_mean_pool(F.col("t"), F.col("m"))).alias("k", "pooled"))
    return rounded(pooled)


@query("linear_heads", H + "SELECT vec_id, task, round(z, 6) AS z FROM long")
def linear_heads(spark, d):
    return rounded(long(spark, d).select("vec_id", "task", "z"))


@query("softmax_confidence", HL + f"SELECT vec_id, round(least({o.TOP('sev')}, {o.TOP('act')}), 6) AS confidence FROM logits")
def softmax_confidence(spark, d):
    return logits(spark, d).select("vec_id", r6(sc.confidence(F.col("severity_logits"), F.col("action_logits"))).alias("confidence"))


def _name(names: tuple[str, ...], x: str) -> str:
    return f"({list(names)!r})[list_position({x}, list_max({x}))]"


@query("argmax_decode", HL + f"SELECT vec_id, {_name(SEVERITIES, 'sev')} AS severity, {_name(ACTIONS, 'act')} AS model_action FROM logits")
def argmax_decode(spark, d):
    return logits(spark, d).select("vec_id", sc.decoded(F.col("severity_logits"), SEVERITIES).alias("severity"), sc.decoded(F.col("action_logits"), ACTIONS).alias("model_action"))


@query("label_encode", HL + "SELECT vec_id, CAST(list_position(sev, list_max(sev)) - 1 AS INT) AS severity_id FROM logits")
def label_encode(spark, d):
    return logits(spark, d).select("vec_id", sc.encoded(sc.decoded(F.col("severity_logits"), SEVERITIES), SEVERITIES).alias("severity_id"))


@query("binary_certainty", H + "SELECT vec_id, round(greatest(0, least(1, 2 * max(abs(p - 0.5)))), 6) AS certainty FROM long GROUP BY vec_id")
def binary_certainty(spark, d):
    return rounded(long(spark, d).groupBy("vec_id").agg(sc.certainty(F.collect_list("p")).alias("certainty")))


@query("calibrate_scores", H + "SELECT vec_id, task, round(p_raw, 6) AS raw, round(p, 6) AS calibrated FROM long")
def calibrate_scores(spark, d):
    return long(spark, d).select("vec_id", "task", r6(sc.sigmoid(F.col("z"))).alias("raw"), r6("p").alias("calibrated"))


@query("score_floor", H + "SELECT vec_id, task, round(CASE WHEN task IN ('pii', 'secret') AND label % 3 = 0 THEN greatest(p, 0.95) ELSE p END, 6) AS score FROM long")
def score_floor(spark, d):
    seen = F.col("task").isin("pii", "secret") & (F.col("label") % 3 == 0)
    return long(spark, d).select("vec_id", "task", r6(sc.floored(F.col("p"), seen)).alias("score"))


_REC = H[:-1] + f", {o.LOGITS}, wide AS (SELECT vec_id, " + ", ".join(f"max(CASE WHEN task = '{t}' THEN 1 / (1 + exp(-ln(pc / (1 - pc)))) END) AS {t}" for t in TASKS) + """ FROM long GROUP BY vec_id),
rec AS (SELECT w.* REPLACE (CASE WHEN label % 3 = 0 THEN greatest(w.pii, 0.95) ELSE w.pii END AS pii), label, sev, act, """ + f"least({o.TOP('sev')}, {o.TOP('act')}) AS c" + """ FROM wide w JOIN logits USING (vec_id)),
verdicts AS (SELECT *, CASE WHEN label % 3 = 0 AND label % 2 = 0 THEN 'REDACT/pii_external_transfer' WHEN c < CAST(0.6 AS DOUBLE) THEN 'REVIEW/uncertain' WHEN prompt_injection >= CAST(0.7 AS DOUBLE) THEN 'BLOCK/prompt_injection'
WHEN dangerous_instruction >= CAST(0.75 AS DOUBLE) THEN 'BLOCK/dangerous_instruction' WHEN secret >= CAST(0.65 AS DOUBLE) THEN 'REVIEW/unverified_secret_score' WHEN pii >= CAST(0.65 AS DOUBLE) AND label % 2 = 0 THEN 'REDACT/pii_external_transfer'
WHEN greatest(""" + ", ".join(TASKS) + ") >= CAST(0.7 AS DOUBLE) OR label % 3 = 0 THEN 'REVIEW/elevated_risk' ELSE 'ALLOW/low_risk' END AS v FROM rec)"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records with stand-in evidence: personal data where the label is divisible by 3, a transfer where it is even."""
    return decision_records(logits(spark, d).withColumns(evidence_stand_in()))


def evidence_stand_in() -> dict[str, Column]:
    return {"has_pii": F.col("label") % 3 == 0, "has_secret": F.lit(False), "transfer": F.col("label") % 2 == 0}


@query("decision_record", _REC + f" SELECT vec_id, {', '.join(f'round({t}, 6) AS {t}' for t in TASKS)}, {_name(SEVERITIES, 'sev')} AS severity, {_name(ACTIONS, 'act')} AS model_action, split_part(v, '/', 1) AS action, split_part(v, '/', 2) AS policy_reason, round_even(c, 4) AS confidence, v = 'REVIEW/uncertain' AS abstain FROM verdicts")
def decision_record(spark, d):
    return rounded(records(spark, d).select("vec_id", *TASKS, "severity", "model_action", "action", "policy_reason", "confidence", "abstain"), "confidence")


@query("decision_display", _REC + " SELECT vec_id, CASE split_part(v, '/', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DISPLAY.items()) + " END AS reason, c < CAST(0.6 AS DOUBLE) AND split_part(v, '/', 1) = 'REVIEW' AS abstain FROM verdicts")
def decision_display(spark, d):
    return records(spark, d).select("vec_id", rules.display_reason(F.col("policy_reason")).alias("reason"), "abstain")


# --- metrics ----------------------------------------------------------------------------------------------------------------
@query("pred_truth_join", "SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS positives FROM documents JOIN labels USING (doc_id)")
def pred_truth_join(spark, d):
    joined = docs(spark, d).select("doc_id").join(read_table(spark, d, "labels"), "doc_id")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("positives"))


@query("task_unpivot", "SELECT doc_id, 'quality' AS task, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def task_unpivot(spark, d):
    return read_table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "task", "y")


@query("confusion", H + o.counted("long", "task"))
def confusion(spark, d):
    return mt.confusion(mt.with_prediction(long(spark, d)), "task")


_METRICS = f"m AS (SELECT task, {o.RATE_LIST.replace('round(', '(').replace(', 6)', ')')}, tp + fn AS support FROM ({o.counted('long', 'task')}))"


@query("task_metrics", H + f"SELECT task, {o.RATE_LIST}, tp + fn AS support FROM ({o.counted('long', 'task')})")
def task_metrics(spark, d):
    return rounded(mt.task_metrics(mt.with_prediction(long(spark, d)), "task"))


@query("macro_metrics", H[:-1] + f", {_METRICS} SELECT round(avg(f1), 6) AS macro_f1, round(avg(accuracy), 6) AS macro_accuracy, round(avg(recall), 6) AS macro_recall FROM m")
def macro_metrics(spark, d):
    return rounded(mt.macro(mt.task_metrics(mt.with_prediction(long(spark, d)), "task"), "f1", "accuracy", "recall"))


@query("metrics_by_language", f"WITH b AS (SELECT lang, toxic AS y, CAST(regexp_matches(text, '[0-9]') AS INT) AS p FROM documents JOIN labels USING (doc_id)) SELECT lang, {o.RATE_LIST}, tp + fn AS support FROM ({o.counted('b', 'lang')})")
def metrics_by_language(spark, d):
    scored = docs(spark, d).join(read_table(spark, d, "labels"), "doc_id").select("lang", F.col("toxic").alias("y"), F.col("text").rlike("[0-9]").cast("int").alias("p"))
    return rounded(mt.task_metrics(mt.with_prediction(scored), "lang"))


@query("error_sample", H + "SELECT task, vec_id FROM (SELECT task, vec_id, row_number() OVER (PARTITION BY task ORDER BY vec_id) AS rn FROM long WHERE (p >= 0.5) <> (y = 1)) WHERE rn <= 12")
def error_sample(spark, d):
    wrong = mt.with_prediction(long(spark, d)).where("pred <> y")
    return tuning.first_in_group(wrong, "task", "vec_id", 12).select("task", "vec_id")


@query("any_risk_rate", H + "SELECT round(sum(CAST(top >= 0.5 AS INT)) / greatest(1, count(*)), 6) AS rate FROM (SELECT vec_id, max(p) AS top FROM long WHERE task IN ('privacy_risk', 'security_risk', 'ethics_risk', 'oversight_risk', 'data_governance_risk') GROUP BY vec_id)")
def any_risk_rate(spark, d):
    top = long(spark, d).where(F.col("task").isin(*ANY_RISK_TASKS)).groupBy("vec_id").agg(F.max("p").alias("top"))
    return rounded(top.agg((F.count_if(F.col("top") >= 0.5) / F.greatest(F.lit(1), F.count("*"))).alias("rate")))


@query("intervention_rate", _REC + " SELECT round(avg(CAST(split_part(v, '/', 1) IN ('REVIEW', 'BLOCK', 'REDACT') AS INT)), 6) AS rate FROM verdicts")
def intervention_rate(spark, d):
    return rounded(records(spark, d).agg(F.avg(F.col("action").isin("REVIEW", "BLOCK", "REDACT").cast("int")).alias("rate")))


_BINS = f"bins AS (SELECT task, {o.EDGE_BIN} AS bin, count(*) AS n, avg(y) AS mean_y, avg(p) AS mean_p FROM long GROUP BY 1, 2)"


@query("ece_bins", H[:-1] + f", {_BINS} SELECT task, bin, n, round(mean_y, 6) AS mean_y, round(mean_p, 6) AS mean_p FROM bins")
def ece_bins(spark, d):
    return rounded(mt.ece_bins(long(spark, d), "task"))


_MASS = "edged AS (SELECT task, list_transform(range(1, 10), lambda i: ps[CAST(floor(len(ps) * i / 10.0) AS BIGINT) + 1]) AS edges FROM (SELECT task, list_sort(list(p)) AS ps FROM long GROUP BY task)), massed AS (SELECT task, len(list_filter(edges, lambda e: e <= p)) AS bin, y, p FROM long JOIN edged USING (task))"


@query("ece_equal_mass", H[:-1] + f", {_MASS} SELECT task, round(sum(n * abs(my - mp)) / sum(n), 6) AS ece, count(*) AS bins FROM (SELECT task, bin, count(*) AS n, avg(y) AS my, avg(p) AS mp FROM massed GROUP BY task, bin) GROUP BY task")
def ece_equal_mass(spark, d):
    """Calibration error over ten bins of equally many scores: each task's edges are exact order statistics, joined as data."""
    scored = long(spark, d).select("task", "y", "p")
    edges = ranks.values_at_ranks(scored, "p", lambda n: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.floor(n * i / 10)), "task").withColumnRenamed("p", "edges")
    return rounded(mt.ece_by_edges(scored, edges, "task"))


@query("ece", H[:-1] + f", {_BINS} SELECT task, round(sum(n * abs(mean_y - mean_p)) / sum(n), 6) AS ece FROM bins GROUP BY task")
def ece(spark, d):
    return rounded(mt.ece(long(spark, d), "task"))


_BN = "SELECT task, avg((q - y) * (q - y)) AS brier, -avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS nll FROM (SELECT task, y, greatest(least(p, 1 - 1e-7), 1e-7) AS q FROM long) GROUP BY task"


@query("brier_nll", H + f"SELECT task, round(brier, 6) AS brier, round(nll, 6) AS nll FROM ({_BN})")
def brier_nll(spark, d):
    return rounded(mt.brier_nll(long(spark, d), "task"))


@query("calibration_summary", H[:-1] + f", {_BINS} SELECT round(avg(ece), 6) AS mean_ece, round(avg(brier), 6) AS mean_brier, round(avg(nll), 6) AS mean_nll FROM (SELECT task, sum(n * abs(mean_y - mean_p)) / sum(n) AS ece FROM bins GROUP BY task) JOIN ({_BN}) USING (task)")
def calibration_summary(spark, d):
    return rounded(mt.calibration(long(spark, d), "task").agg(F.avg("ece").alias("mean_ece"), F.avg("brier").alias("mean_brier"), F.avg("nll").alias("mean_nll")))


# --- sweeps and selections ----------------------------------------------------------------------------------------------------
_CURVE = H[:-1] + ", one AS (SELECT p, y, threshold FROM long, (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 100, 5) AS r(i)) WHERE task = 'prompt_injection'), curve AS (SELECT threshold, " + ", ".join(f"{o.RATES[n]} AS {a}" for n, a in (("f1", "f1"), ("recall", "recall"), ("precision", "precision"), ("false_positive_rate", "fpr"))) + f" FROM ({o.counted('one', 'threshold', threshold='threshold')}))"
_CURVE_OUT = "threshold, round(f1, 6) AS f1, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS fpr"


@query("threshold_sweep", _CURVE + f" SELECT {_CURVE_OUT} FROM curve")
def threshold_sweep(spark, d):
    return rounded(tuning.threshold_sweep(long(spark, d).where("task = 'prompt_injection'")), "threshold")


@query("threshold_select", _CURVE + f" SELECT {_CURVE_OUT} FROM curve ORDER BY curve.f1 DESC, curve.fpr, threshold LIMIT 1")
def threshold_select(spark, d):
    return rounded(tuning.best_threshold(tuning.threshold_sweep(long(spark, d).where("task = 'prompt_injection'"))), "threshold")


_BLEND = H[:-1] + ", mixed AS (SELECT alpha, CASE WHEN vec_id % 2 = 0 THEN 'synthetic' ELSE 'external' END AS part, y, 1 / (1 + exp(-((1 - alpha) * ln(pc / (1 - pc)) + alpha * ln(pc1 / (1 - pc1))))) AS p FROM long, (SELECT CAST(unnest([0, .1, .2, .3, .4, .5, .6, .8, 1]) AS DOUBLE) AS alpha) WHERE task = 'prompt_injection'), sweep AS (SELECT alpha, part, " + ", ".join(f"{o.RATES[n]} AS {a}" for n, a in (("f1", "f1"), ("recall", "recall"), ("false_positive_rate", "fpr"))) + f" FROM ({o.counted('mixed', 'alpha', 'part')}))"


def blends(spark: SparkSession, d: str) -> DataFrame:
    two = long(spark, d).where("task = 'prompt_injection'").select("y", F.when(F.col("vec_id") % 2 == 0, "synthetic").otherwise("external").alias("part"), sc.sigmoid(F.col("z")).alias("p0"), sc.sigmoid(F.col("z1")).alias("p1"))
    return tuning.blend_sweep(two, "part")


@query("blend_sweep", _BLEND + " SELECT alpha, part, round(f1, 6) AS f1, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM sweep")
def blend_sweep(spark, d):
    return rounded(blends(spark, d), "alpha")


@query("blend_select", _BLEND + " SELECT alpha, round(s, 6) AS synthetic_f1, round(e, 6) AS external_f1 FROM (SELECT alpha, max(CASE WHEN part = 'synthetic' THEN f1 END) AS s, max(CASE WHEN part = 'external' THEN f1 END) AS e FROM sweep GROUP BY alpha) WHERE s >= 0.3 ORDER BY e DESC, alpha LIMIT 1")
def blend_select(spark, d):
    return rounded(tuning.best_blend(blends(spark, d), gate=0.3), "alpha")


_GRID = "grid AS (SELECT round(0.3 * exp(i * ln(CAST(10 AS DOUBLE) / 0.3) / 35), 6) AS g FROM range(36) AS r(i))"


@query("temperature_grid", H[:-1] + f", {_GRID}, fit AS (SELECT task, g, -avg(CASE WHEN y = 1 THEN ln(greatest(least(1 / (1 + exp(-z / g)), 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(1 / (1 + exp(-z / g)), 1 - 1e-7), 1e-7)) END) AS nll FROM long, grid GROUP BY task, g) SELECT task, arg_min(g, nll) AS temperature FROM fit GROUP BY task")
def temperature_grid(spark, d):
    return tuning.temperature_grid(long(spark, d), "task")


_FIT = f"""t AS (SELECT task, g AS t0 FROM (SELECT task, arg_min(g, nll) AS g FROM (SELECT task, g, {{loss}} AS nll FROM long, grid GROUP BY task, g) GROUP BY task)),
r1 AS (SELECT task, arg_min(g, nll) AS t1 FROM (SELECT task, g, {{loss}} AS nll FROM (SELECT long.*, greatest(t0 / {{s1}}, 0.3) * pow(least(t0 * {{s1}}, 10) / greatest(t0 / {{s1}}, 0.3), CAST(i AS DOUBLE) / 24) AS g FROM long JOIN t USING (task), range(25) AS r(i)) GROUP BY task, g) GROUP BY task),
r2 AS (SELECT task, arg_min(g, nll) AS t2 FROM (SELECT task, g, {{loss}} AS nll FROM (SELECT long.*, greatest(t1 / {{s2}}, 0.3) * pow(least(t1 * {{s2}}, 10) / greatest(t1 / {{s2}}, 0.3), CAST(i AS DOUBLE) / 24) AS g FROM long JOIN r1 USING (task), range(25) AS r(i)) GROUP BY task, g) GROUP BY task)"""
_LOSS = "-avg(CASE WHEN y = 1 THEN ln(greatest(least(1 / (1 + exp(-z / g)), 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(1 / (1 + exp(-z / g)), 1 - 1e-7), 1e-7)) END)"
_STEP = (10.0 / 0.3) ** (1 / 35)


@query("temperature_fit", H[:-1] + f", {_GRID}, " + _FIT.format(loss=_LOSS, s1=f"CAST({_STEP!r} AS DOUBLE)", s2=f"CAST({_STEP ** (2 / 24)!r} AS DOUBLE)") + " SELECT task, round(t2, 6) AS temperature FROM r2")
def temperature_fit(spark, d):
    return rounded(tuning.temperature_fit(long(spark, d), "task"))


_EIGHTHS = lambda sql: sql.replace("CAST(v AS DOUBLE)", "floor(CAST(v AS DOUBLE) * 8 + 0.5) / 8")


def coarse(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings with `exact` ones beside those rounded to eighths: what a second, quantised backend would see."""
    rounded_ = F.transform("embedding", lambda v: F.floor(v.cast("double") * 8 + 0.5) / 8)
    return read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("exact"), rounded_.alias("coarse"))


@query("action_disagreement", f"SELECT count(*) AS examples, round(avg(CAST(a.action <> b.action AS INT)), 6) AS disagreement FROM ({_REC} SELECT vec_id, split_part(v, '/', 1) AS action FROM verdicts) a JOIN ({_EIGHTHS(_REC)} SELECT vec_id, split_part(v, '/', 1) AS action FROM verdicts) b USING (vec_id)")
def action_disagreement(spark, d):
    """Share of rows on which the final actions of an exact and a quantised backend differ; both are decided in one pass."""
    given = coarse(spark, d).withColumns(evidence_stand_in())
    for name in ("exact", "coarse"):
        given = decision_records(given.withColumns(logits_of(F.col(name)))).withColumnRenamed("action", f"{name}_action").drop(*TASKS, "severity", "model_action", "policy_reason", "confidence", "abstain")
    return rounded(given.agg(F.count("*").alias("examples"), F.avg((F.col("exact_action") != F.col("coarse_action")).cast("int")).alias("disagreement")))


@query("backend_f1", f"SELECT task, round({o.RATES['f1'].replace('tp', 'a.tp').replace('fp', 'a.fp').replace('fn', 'a.fn')}, 6) AS exact, round({o.RATES['f1'].replace('tp', 'b.tp').replace('fp', 'b.fp').replace('fn', 'b.fn')}, 6) AS coarse FROM ({H} {o.counted('long', 'task')}) a JOIN ({_EIGHTHS(H)} {o.counted('long', 'task')}) b USING (task)")
def backend_f1(spark, d):
    """Each task's f1 by the two backends, counted in one pass."""
    both = F.array(*[F.struct(F.lit(n).alias("backend"), F.transform(n, lambda v: v.cast("double")).alias("embedding")) for n in ("exact", "coarse")])
    scored = heads(coarse(spark, d).select("vec_id", "label", F.inline(both)), "backend")
    f1 = mt.task_metrics(mt.with_prediction(scored), "task", "backend")
    return rounded(f1.groupBy("task").agg(*[F.max(F.when(F.col("backend") == n, F.col("f1"))).alias(n) for n in ("exact", "coarse")]))


_BCE = lambda z, y: f"(greatest({z}, 0) - {z} * {y} + ln(1 + exp(-abs({z}))))"
_CE = lambda x, i: f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))) - {x}[{i} + 1])"


@query("distill_loss", HL + f", task_loss AS (SELECT avg({_BCE('z', 'y')}) AS l FROM long), teach AS (SELECT avg({_BCE('z', 'greatest(least(1 / (1 + exp(-z1)), 0.99), 0.01)')}) AS l FROM long WHERE (1 / (1 + exp(-z1)) >= 0.5) = (y >= 0.5)), heads AS (SELECT avg({_CE('sev', 'label % 4')}) AS s, avg({_CE('act', '(label + 1) % 4')}) AS a FROM logits) SELECT round(task_loss.l + 0.3 * s + 0.3 * a + 0.05 * coalesce(teach.l, 0), 6) AS loss FROM task_loss, teach, heads")
def distill_loss(spark, d):
    """Task, severity and action losses, and teacher targets where they are usable."""
    scored = long(spark, d).withColumn("teacher", sc.sigmoid(F.col("z1")))
    target = F.least(F.greatest("teacher", F.lit(0.01)), F.lit(0.99))
    usable = sc.teacher_usable(F.col("teacher"), F.col("y"))
    parts = scored.agg(F.avg(sc.binary_cross_entropy(F.col("z"), F.col("y"))).alias("task"), F.coalesce(F.avg(F.when(usable, sc.binary_cross_entropy(F.col("z"), target))), F.lit(0.0)).alias("taught"))
    heads = logits(spark, d).agg(F.avg(sc.cross_entropy(F.col("severity_logits"), F.col("label") % 4)).alias("s"), F.avg(sc.cross_entropy(F.col("action_logits"), (F.col("label") + 1) % 4)).alias("a"))
    return parts.crossJoin(heads).select(r6(F.col("task") + 0.3 * F.col("s") + 0.3 * F.col("a") + 0.05 * F.col("taught")).alias("loss"))  # one row each


@query("teacher_join", "WITH teacher AS (SELECT text, toxic AS score, doc_id FROM documents JOIN labels USING (doc_id)), latest AS (SELECT text, arg_max(score, doc_id) AS score FROM teacher GROUP BY text) SELECT doc_id, score FROM documents LEFT JOIN latest USING (text)")
def teacher_join(spark, d):
    """The latest teacher row of each text, here the label of the last document with it; null where there is none.

    Texts meet by their digest, so no text is shuffled.
    """
    rows = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))
    latest = rows.join(read_table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").groupBy("digest").agg(F.max_by("toxic", "doc_id").alias("score"))
    return rows.join(latest, "digest", "left").select("doc_id", "score")


@query("teacher_mask", H + "SELECT vec_id, task, round(p1_raw, 6) AS score FROM long WHERE (p1_raw >= 0.5) = (y = 1)")
def teacher_mask(spark, d):
    """The second backend's scores, as a teacher's, where they are on the label's side."""
    rows = long(spark, d).withColumn("score", sc.sigmoid(F.col("z1")))
    return rounded(rows.where(sc.teacher_usable(F.col("score"), F.col("y"))).select("vec_id", "task", "score"))


@query("best_epoch", H[:-1] + f", ep AS (SELECT CAST(1 + vec_id % 10 AS INT) AS epoch, y, p FROM long WHERE task = 'pii'), hist AS (SELECT epoch, {o.RATES['f1']} AS validation_f1 FROM ({o.counted('ep', 'epoch')})) SELECT epoch, round(validation_f1, 6) AS validation_f1 FROM hist ORDER BY hist.validation_f1 DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    """The first of best f1 in a history, here of tenths of the vectors in place of epochs; head_history has a training's own."""
    parts = long(spark, d).where("task = 'pii'").withColumn("epoch", (1 + F.col("vec_id") % 10).cast("int"))
    history = mt.task_metrics(mt.with_prediction(parts), "epoch").select("epoch", F.col("f1").alias("validation_f1"))
    return rounded(tuning.best_epoch(history))


@query("trailing_mean_25", "SELECT user_id, event_id, round(m, 6) AS trailing_mean FROM (SELECT user_id, event_id, row_number() OVER w AS step, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE step % 25 = 0")
def trailing_mean_25(spark, d):
    return rounded(windows.trailing_mean(read_table(spark, d, "events"), "value", "event_id", "user_id").select("user_id", "event_id", "trailing_mean"))


@query("latency_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(list_sort(list(value))[count(value) // 2 + 1], 6) AS p50, count(value) AS n FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return rounded(mt.latency(read_table(spark, d, "events"), "value", "event_type"))


# --- synthetic corpus -----------------------------------------------------------------------------------------------------------
_CASE = lambda m: "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
_NINE = lambda i: f"CAST(substr(nine, {i + 1}, 1) AS INT)"
_TENTH = "(((" + " + ".join(map(_NINE, range(0, 9, 2))) + ") * 7 - (" + " + ".join(map(_NINE, range(1, 8, 2))) + ")) % 10 + 10) % 10"
_TC = f"nine || ({_TENTH}) || ((" + " + ".join(map(_NINE, range(9))) + f" + ({_TENTH})) % 10)"
_TEMPLATE = f"replace(({_CASE(synth.STEMS)}) || ' #' || tid, '{{extra}}', ({list(synth.EXTRAS)!r})[tid + 1])"
_TEXT = "replace(replace(replace(replace(replace(replace(replace(template, '{person}', (" + repr(list(synth.PERSONS)) + ")[1 + id % 4]), '{email}', 'sample' || n || '@example.org'), '{phone}', '0532' || lpad(CAST(n % 10000000 AS VARCHAR), 7, '0')), '{tc}', tc), '{secret}', 'synthetic_KEY_' || lpad(CAST(n AS VARCHAR), 8, '0') || '_ABCDEF'), '{object}', (" + repr(list(synth.OBJECTS)) + ")[1 + id % 2]), '{n}', CAST(n AS VARCHAR))"
_SYNTH = f"WITH {o.SYNTH}, tpl AS (SELECT *, {_TC} AS tc, {_TEMPLATE} AS template FROM fam), lab AS (SELECT *, " + ", ".join("CAST(category IN (" + ", ".join(f"'{c}'" for c, f in synth.FLAGS.items() if t in f) + f") AS INT) AS {t}0" for t in TASKS) + " FROM tpl), fin AS (SELECT *, CASE WHEN category = 'MULTI_RISK' AND (template LIKE '%secret%' OR template LIKE '%token%') THEN 1 ELSE secret0 END AS secret, CASE WHEN category = 'MULTI_RISK' AND (template LIKE '%Ignore%' OR template LIKE '%Reveal%') THEN 1 ELSE prompt_injection0 END AS prompt_injection FROM lab), act AS (SELECT *, secret + prompt_injection + dangerous_instruction0 > 0 AS blocked FROM fin)"


def made_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A made row for each document, by its number."""
    return synth.corpus_of(docs(spark, d).select(F.col("doc_id").cast("long").alias("id")))


@query("synth_corpus", _SYNTH + f" SELECT id, category, family, {_TEXT} AS text FROM act")
def synth_corpus(spark, d):
    return made_corpus(spark, d).select("id", "category", "family", "text")


@query("synth_labels", _SYNTH + " SELECT id, secret, prompt_injection, " + ", ".join(f"{t}0 AS {t}" for t in TASKS if t not in ("secret", "prompt_injection")) + ", CASE WHEN category = 'BENIGN' THEN 'ALLOW' WHEN blocked THEN 'BLOCK' WHEN category = 'MULTI_RISK' THEN 'REDACT' ELSE 'REVIEW' END AS action, CASE WHEN category = 'BENIGN' THEN 'LOW' WHEN blocked THEN 'CRITICAL' WHEN category = 'MULTI_RISK' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN tid < 4 THEN 'tr' WHEN tid < 8 THEN 'en' ELSE 'mixed' END AS language FROM act")
def synth_labels(spark, d):
    return made_corpus(spark, d).select("id", *TASKS, "action", "severity", "language")


@query("tc_generate", f"WITH {o.SYNTH} SELECT id, {_TC} AS tc FROM base")
def tc_generate(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id")).select("id", synth.national_id((100_000_000 + (F.col("id") * 104729) % 900_000_000).cast("string")).alias("tc"))


def split_corpus(spark: SparkSession, d: str) -> DataFrame:
    return made_corpus(spark, d).withColumn("split", synth.split_of(F.col("family")))


@query("family_split", f"WITH {o.SYNTH} SELECT id, family, split FROM fam")
def family_split(spark, d):
    return split_corpus(spark, d).select("id", "family", "split")


@query("family_overlap", f"WITH {o.SYNTH} SELECT count(*) AS overlapping FROM (SELECT family FROM fam GROUP BY family HAVING count(DISTINCT split) > 1)")
def family_overlap(spark, d):
    return synth.family_overlap(split_corpus(spark, d)).agg(F.count("*").alias("overlapping"))


@query("split_counts", f"WITH {o.SYNTH} SELECT split, count(*) AS n, count(DISTINCT family) AS families FROM fam GROUP BY split")
def split_counts(spark, d):
    return split_corpus(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"))


_COUNTS = ", ".join(f"least(len(regexp_extract_all(folded, '{words}')), {MOST}) AS c{i}" for i, words in enumerate(LEXICON.values()))
_TOTAL = "CAST(least(" + " + ".join(f"c{i}" for i in range(9)) + ", 6) AS DOUBLE)"
_META = "id % 3 = 0 AS agent, id % 6 = 0 AS shell, id % 4 = 0 AS database, id % 8 <> 0 AS network, id % 9 = 0 AS human_approval, id % 5 = 0 AS external_api"
_HEAT = {t: round(0.8 + 0.1 * i, 1) for i, t in enumerate(TASKS)}
_CALIBRATED = lambda i, t: f"1 / (1 + exp(-ln(q{i} / (1 - q{i})) / CAST({_HEAT[t]} AS DOUBLE)))"
_FLOORED = lambda i, t: f"CASE WHEN has_{t} THEN greatest({_CALIBRATED(i, t)}, 0.95) ELSE {_CALIBRATED(i, t)} END" if t in ("pii", "secret") else _CALIBRATED(i, t)
_ANALYZE = f"""WITH {o.SRC}, {o.ALL}, {o.FLAGS}, seen AS (SELECT id, {_META}, {_COUNTS} FROM (SELECT id, replace(lower(replace(replace(coalesce(text, ''), 'I', 'ı'), 'İ', 'i' || chr(775))), 'ı', 'i') AS folded FROM src)), n_spans AS (SELECT id, count(*) AS n_evidence FROM spans GROUP BY id),
risk AS (SELECT *, {_TOTAL} AS total, {", ".join(f"greatest(least(1 / (1 + exp(-(1.5 * CAST(c{i} AS DOUBLE) - 2.5))), 1 - 1e-7), 1e-7) AS q{i}" for i in range(9))} FROM seen),
soft AS (SELECT risk.*, has_pii, has_secret, transfer OR external_api AS moved, coalesce(n_evidence, 0) AS n_evidence, [2 - total, 0.5 + 0.1 * total, 0.5 * total - 0.5, 0.8 * total - 2] AS sev, [2 - total, 0.9 * CAST(c0 AS DOUBLE) - 1, 0.3 + 0.3 * total, 0.9 * CAST(c1 + c2 + c3 AS DOUBLE) - 2] AS act FROM risk JOIN flags USING (id) LEFT JOIN n_spans USING (id)),
scored AS (SELECT *, {", ".join(f"{_FLOORED(i, t)} AS {t}" for i, t in enumerate(TASKS))}, least({o.TOP("sev")}, {o.TOP("act")}) AS c FROM soft),
told AS (SELECT *, CASE WHEN has_secret THEN 'BLOCK/secret_evidence' WHEN has_pii AND moved THEN 'REDACT/pii_external_transfer' WHEN c < CAST(0.6 AS DOUBLE) THEN 'REVIEW/uncertain' WHEN prompt_injection >= CAST(0.7 AS DOUBLE) THEN 'BLOCK/prompt_injection'
WHEN dangerous_instruction >= CAST(0.75 AS DOUBLE) THEN 'BLOCK/dangerous_instruction' WHEN secret >= CAST(0.65 AS DOUBLE) THEN 'REVIEW/unverified_secret_score' WHEN pii >= CAST(0.65 AS DOUBLE) AND moved THEN 'REDACT/pii_external_transfer'
WHEN agent AND (shell OR (database AND network)) AND NOT human_approval THEN 'REVIEW/agent_permissions' WHEN greatest({", ".join(TASKS)}) >= CAST(0.7 AS DOUBLE) OR has_pii THEN 'REVIEW/elevated_risk' ELSE 'ALLOW/low_risk' END AS v FROM scored)"""


@query("analyze_documents", _ANALYZE + f" SELECT id, {', '.join(f'round({t}, 6) AS {t}' for t in TASKS)}, {_name(SEVERITIES, 'sev')} AS severity, {_name(ACTIONS, 'act')} AS model_action, split_part(v, '/', 1) AS action, split_part(v, '/', 2) AS policy_reason, round_even(c, 4) AS confidence, v = 'REVIEW/uncertain' AS abstain, n_evidence FROM told")
def analyze_documents(spark, d):
    """Texts and flags to records: evidence and scores of the lexicon, row by row without a shuffle of texts; temperatures, floors, confidence, policy."""
    flags = {"agent": "id % 3 = 0", "shell": "id % 6 = 0", "database": "id % 4 = 0", "network": "id % 8 <> 0", "human_approval": "id % 9 = 0", "external_api": "id % 5 = 0"}
    told = analyze(texts(spark, d).withColumns({f: F.expr(x) for f, x in flags.items()}), temperatures=_HEAT)
    shown = told.select("id", *TASKS, "severity", "model_action", "action", "policy_reason", "confidence", "abstain", F.size("evidence").cast("bigint").alias("n_evidence"))
    return rounded(shown, "confidence")


@query("rule_baseline_synthetic", _SYNTH + f", src AS (SELECT id, {_TEXT} AS text FROM act), {o.ALL}, {o.FLAGS}, b AS (SELECT f.*, act.pii0 AS y1, act.secret AS y2 FROM flags f JOIN act USING (id)), m AS (SELECT 'pii' AS task, y1 AS y, CAST(has_pii AS DOUBLE) AS p FROM b UNION ALL SELECT 'secret', y2, CAST(has_secret AS DOUBLE) FROM b) SELECT task, {o.RATE_LIST}, tp + fn AS support FROM ({o.counted('m', 'task')})")
def rule_baseline_synthetic(spark, d):
    """Flags of synthetic rows against the labels of their own tasks."""
    return baseline(with_flags(made_corpus(spark, d)), {"pii": "pii", "secret": "secret"})


def head_rows(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of labelled documents as features: tasks, severity and action by label, quality as the injection task, a second backend as teacher."""
    vectors = read_table(spark, d, "embeddings").join(read_table(spark, d, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")
    risks = F.array(*[(F.col("quality") if t == "prompt_injection" else F.pmod(F.col("label") + i, F.lit(2))).cast("int") for i, t in enumerate(TASKS)])
    teacher = F.array(*[sc.sigmoid(sc.linear(F.col("embedding"), lambda k, i=i: ((i + 2) * (k + 4)) % 5 - 2)) for i in range(len(TASKS))])
    features = F.transform("embedding", lambda x: x.cast("double"))
    held = F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)) == 0
    return vectors.select("vec_id", features.alias("features"), risks.alias("risks"), F.pmod("label", F.lit(4)).alias("severity"), F.pmod(F.col("label") + 1, F.lit(4)).alias("action"), teacher.alias("teacher"), held.alias("held"))


@query("head_history")
def head_history(spark, d):
    """Epochs of the heads' joint training: loss, validation f1 and the epoch whose weights are taken."""
    return rounded(hd.history_table(spark, hd.train(head_rows(spark, d))))


@query("head_finetune")
def head_finetune(spark, d):
    """One task's head trained on from the joint heads: the same history for its epochs."""
    rows = head_rows(spark, d)
    joint = hd.train(rows, epochs=3)
    return rounded(hd.history_table(spark, hd.train(rows, start=joint.weights, only="prompt_injection", rate=0.03)))


def document_heads(spark: SparkSession, d: str) -> hd.Heads:
    """Heads trained on the hashed words of labelled documents outside the fold held out; severity and action follow the labels."""
    labelled = docs(spark, d).select("doc_id", "text").join(read_table(spark, d, "labels"), "doc_id").where(~held_out())
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    tasks = {"dangerous_instruction": toxic, "ethics_risk": toxic, "data_governance_risk": poor}
    risks = F.array(*[F.coalesce(tasks[t].cast("int"), F.lit(0)) if t in tasks else F.lit(0) for t in TASKS])
    severity = F.when(toxic, 3).when(poor, 1).otherwise(0)
    validation = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rows = hd.hashed_features(spread(labelled), 256).select("features", risks.alias("risks"), severity.alias("severity"), F.when(toxic, 3).when(poor, 2).otherwise(0).alias("action"), validation.alias("held"))
    return hd.train(rows, epochs=10, rate=0.5, monitor="data_governance_risk")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


@query("analyze_trained")
def analyze_trained(spark, d):
    """Records of all documents with risk, severity and action from heads trained on the labelled ones."""
    rows = spread(docs(spark, d).select("doc_id", "text"))
    told = analyze(rows, trained_scores(document_heads(spark, d)))
    return rounded(told.select("doc_id", held_out().alias("held_out"), "ethics_risk", "data_governance_risk", "severity", "model_action", "action", "policy_reason", "confidence", "abstain"), "confidence")


@query("surrogate_heads")
def surrogate_heads(spark, d):
    """The nine tasks' logistic regressions on hashed words, trained on the synthetic training families, scored on the others."""
    from ..operators.surrogate import fit_heads, score_heads

    rows = split_corpus(spark, d)
    models = fit_heads(rows.where("split = 'train'"), TASKS)
    scored = score_heads(rows.where("split <> 'train'"), models)
    long_ = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("y"), F.element_at("risks", i + 1).alias("z")) for i, t in enumerate(TASKS)])
    return scored.select("id", "split", F.inline(long_)).select("id", "split", "task", "y", r6(sc.sigmoid(F.col("z"))).alias("p"))


@query("surrogate_scores")
def surrogate_scores(spark, d):
    """Logistic regression on hashed words in place of the encoder: trained on labelled documents outside the fold held out, scores for all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer
    from pyspark.ml.functions import vector_to_array

    table = docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    train = table.where(~held).join(read_table(spark, d, "labels").select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    steps = [Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12), LogisticRegression(maxIter=8, regParam=0.01)]
    scored = Pipeline(stages=steps).fit(train).transform(table)
    return scored.select("doc_id", held.alias("held_out"), r6(vector_to_array("probability")[1]).alias("score"))
