"""DuckDB SQL that states the same results as the queries, written independently of them."""

from __future__ import annotations

from ..constants import PII_TYPES, SECRET_TYPES
from ..constants import TASKS as _TASKS
from . import fixtures as fx

R = lambda x: f"round({x}, 6)"
SRC = f"src AS (SELECT -id AS id, text FROM {fx.values(fx.TEXTS, 'id, text')} UNION ALL SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1000 - doc_id AS id, 'note ' || doc_id || ': ' || ({fx.listed(fx.TEXTS)})[1 + doc_id % {len(fx.TEXTS)}] AS text FROM documents)"
TASKS = list(_TASKS)
TASK_ROWS = "tasks(task_id, task) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TASKS)) + ")"
LETTER = r"[\p{L}\p{N}_]"
# The detectors' patterns without lookaround; digit boundaries take its place.
PATTERNS = {
    "TC_KIMLIK": r"[0-9]+",
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "PHONE": r"\b(?:90\s?)?(?:0?5\d{2})[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "CARD": r"[A-Za-z_]*(?:\d[ -]?){12,18}\d\b[ -]?",
    "IBAN": r"(?i)\bTR\d{2}(?:[ ]?\d{4}){5}[ ]?\d{2}\b",
    "ADDRESS": r"(?i)\b(?:adres|address)\s*[:=]\s*[^\n,;]{8,80}",
    "NAME": r"(?i)\b(?:ad soyad|full name|müşteri adı)\s*[:=]\s*[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]+",
    "CUSTOMER_ID": r"(?i)\b(?:müşteri no|customer id)\s*[:=]\s*[A-Z0-9-]{5,20}\b",
    "API_KEY": r"(?i)\b(?:api[_ -]?key|token)\s*[:=]\s*[A-Z0-9_\-]{16,}\b",
    "BEARER": r"(?i)\bBearer\s+[A-Z0-9._~+/=-]{16,}",
    "PRIVATE_KEY": r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "GITHUB_TOKEN": r"(?i)\b(?:ghp|gho|ghs|ghu)_[A-Z0-9]{20,}\b",
    "AWS_KEY": r"(?i)\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "PASSWORD": r"(?i)\b(?:password|parola|şifre)\s*[:=]\s*[^\s,;]{6,}",
    "DB_CREDENTIAL": r"(?i)\b(?:postgres|mysql|mongodb)://[^\s:@]+:[^\s@]+@[^\s]+",
    "ENV_SECRET": r"(?i)\b[A-Z][A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|KEY)\s*=\s*[^\s]{8,}",
    "PII_MENTION": rf"(?i)\b(?:TC kimlik numara{LETTER}*|social security number\b|passport number\b|müşteri listesi\b|customer list\b)",
    "EXTERNAL_TRANSFER": rf"(?i)\b(?:gönder{LETTER}*|aktar{LETTER}*|send\b|upload\b|exfiltrate\b|API'ye\b)",
}
PII, SECRET = str(PII_TYPES), str(SECRET_TYPES)


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    step = lambda c, i: f"(CASE WHEN {i} % 2 = 0 THEN {c} * 2 - (CASE WHEN {c} > 4 THEN 9 ELSE 0 END) ELSE {c} END)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({d}), ''), lambda c, i: {step('CAST(c AS INT)', 'i')})) % 10 = 0)"


def ip(x: str) -> str:
    return f"len(list_filter(string_split({x}, '.'), lambda o: TRY_CAST(o AS INT) > 255 OR (length(o) > 1 AND o[1] = '0'))) = 0"


def tc(x: str) -> str:
    d = lambda i: f"CAST(substr({x}, {i + 1}, 1) AS INT)"
    s = lambda r: "(" + " + ".join(d(i) for i in r) + ")"
    return f"(length({x}) = 11 AND {d(0)} <> 0 AND ((({s(range(0, 9, 2))} * 7 - {s(range(1, 8, 2))}) % 10) + 10) % 10 = {d(9)} AND {s(range(10))} % 10 = {d(10)})"


VALID = {"IP": ip("v"), "CARD": luhn("v"), "TC_KIMLIK": f"CASE WHEN length(v) = 11 THEN {tc('v')} ELSE false END"}


def spans(kind: str, source: str = "src") -> str:
    """id, ordinal, type, text, start, end of one detector's spans in source(id, text)."""
    p = PATTERNS[kind].replace("'", "''")
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    value, start = "v", "a"
    if kind == "CARD":  # letters before the digits, and a separator that another digit follows, aren't part of the span
        start = "a + length(v) - length(regexp_replace(v, '^[A-Za-z_]+', ''))"
        value = "CASE WHEN regexp_matches(v, '[ -]$') AND regexp_matches(follows, '[0-9]') THEN substr(regexp_replace(v, '^[A-Za-z_]+', ''), 1, length(regexp_replace(v, '^[A-Za-z_]+', '')) - 1) ELSE regexp_replace(v, '^[A-Za-z_]+', '') END"
    return f"""SELECT id, {list(PATTERNS).index(kind)} AS n, '{kind}' AS type, v AS text, CAST(a AS INT) AS start, CAST(a + length(v) AS INT) AS "end" FROM (SELECT id, {value} AS v, {start} AS a FROM (
SELECT id, m[i] AS v, substr(CASE WHEN g[i + 1] = '' THEN coalesce(m[i + 1], '') ELSE g[i + 1] END, 1, 1) AS follows, {length("g[1:i]")} + {length("m[1:i-1]")} AS a FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
SELECT id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM {source} WHERE text IS NOT NULL)))) WHERE {VALID.get(kind, 'true')}"""


ALL = "spans AS (" + " UNION ALL ".join(spans(k) for k in PATTERNS) + ")"
FLAGS = f"flags AS (SELECT id, coalesce(bool_or(type IN {PII}), false) AS has_pii, coalesce(bool_or(type IN {SECRET}), false) AS has_secret, coalesce(bool_or(type = 'EXTERNAL_TRANSFER'), false) AS transfer FROM src LEFT JOIN spans USING (id) GROUP BY id)"
RULES = "CASE WHEN has_secret THEN 'BLOCK/secret_evidence' WHEN has_pii AND transfer THEN 'REDACT/pii_external_transfer' WHEN has_pii THEN 'REVIEW/elevated_risk' ELSE 'ALLOW/low_risk' END"

_dot = lambda w: f"list_sum(list_transform(x, lambda v, k: v * ({w})))"
HEADS = f"""{TASK_ROWS}, e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
zs AS (SELECT vec_id, label, task_id, task, {_dot("((task_id + 1) * (k + 2)) % 7 - 3")} AS z, {_dot("((task_id + 2) * (k + 4)) % 5 - 2")} AS z1, CASE WHEN (label + task_id) % 2 = 0 THEN 1 ELSE 0 END AS y, CAST(0.5 + 0.25 * task_id AS DOUBLE) AS t FROM e, tasks),
raw AS (SELECT *, 1 / (1 + exp(-z)) AS p_raw, 1 / (1 + exp(-z1)) AS p1_raw FROM zs),
cut AS (SELECT *, greatest(least(p_raw, 1 - 1e-7), 1e-7) AS pc, greatest(least(p1_raw, 1 - 1e-7), 1e-7) AS pc1 FROM raw),
long AS (SELECT *, 1 / (1 + exp(-ln(pc / (1 - pc)) / t)) AS p FROM cut)"""
LOGITS = "logits AS (SELECT vec_id, label, " + ", ".join("[" + ", ".join(_dot(f"(({j} + {a}) * (k + {b - 1})) % 5 - 2") for j in range(4)) + f"] AS {n}" for n, a, b in (("sev", 2, 5), ("act", 3, 1))) + " FROM e)"
TOP = lambda x: f"1 / list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))"


def counted(source: str, *by: str, score: str = "p", threshold: str = "0.5") -> str:
    group = "".join(f"{b}, " for b in by)
    return f"SELECT {group}count(*) FILTER (y = 1 AND {score} >= {threshold}) AS tp, count(*) FILTER (y = 0 AND {score} >= {threshold}) AS fp, count(*) FILTER (y = 1 AND {score} < {threshold}) AS fn, count(*) FILTER (y = 0 AND {score} < {threshold}) AS tn FROM {source}" + (f" GROUP BY {', '.join(by)}" if by else "")


RATES = {
    "accuracy": "(tp + tn) / (tp + fp + fn + tn)", "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END",
    "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "false_positive_rate": "fp / greatest(1, fp + tn)", "false_negative_rate": "fn / greatest(1, fn + tp)",
}
RATE_LIST = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in RATES.items())
EDGE_BIN = "(" + " + ".join(f"CAST(p >= CAST({i * 0.1!r} AS DOUBLE) AS INT)" for i in range(1, 10)) + ")"
SYNTH_CATEGORIES = ["BENIGN", "PII", "SECRET", "PROMPT_INJECTION", "DANGEROUS", "PRIVACY_RISK", "SECURITY_RISK", "OVERSIGHT_RISK", "DATA_GOVERNANCE", "AGENT_RISK", "MULTI_RISK"]
SYNTH = f"""base AS (SELECT CAST(id AS BIGINT) AS id, ({SYNTH_CATEGORIES!r})[1 + id % 11] AS category, CAST((id // 11) % 10 AS INT) AS tid, 10000000 + (id * 7919) % 90000000 AS n, CAST(100000000 + (id * 104729) % 900000000 AS VARCHAR) AS nine FROM (SELECT doc_id AS id FROM documents)),
fam AS (SELECT *, category || '-' || tid AS family, CASE WHEN tid < 7 THEN 'train' WHEN tid = 7 THEN 'val' ELSE 'test' END AS split FROM base)"""


def wordpieces(size: int, ends: int = 4) -> str:
    """CTEs vocab(piece, id) and tokens(doc_id, ids) of documents; ids by longest match from the left, word by word."""
    norm = "lower(replace(replace(coalesce(text, ''), 'I', 'ı'), 'İ', 'i' || chr(775)))"
    pattern = r"[^\x00-\x20!-/:-@\[-`{-\x7F]+|[!-/:-@\[-`{-~]"
    return f"""worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all({norm}, '{pattern}') AS ws FROM documents),
single AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM worded) GROUP BY w),
short AS (SELECT * FROM single WHERE length(w) <= 100), ks AS (SELECT unnest(range(1, {ends + 1})) AS k),
cand AS (SELECT w AS piece, n FROM short UNION ALL SELECT substr(w, 1, k), n FROM short, ks WHERE length(w) > k UNION ALL SELECT '##' || substr(w, length(w) - k + 1), n FROM short, ks WHERE length(w) > k
  UNION ALL SELECT '##' || substr(w, i, 1), n FROM (SELECT w, n, unnest(range(2, length(w))) AS i FROM short)),
vocab AS MATERIALIZED (SELECT piece, CAST(3 + row_number() OVER (ORDER BY n DESC, piece) AS INTEGER) AS id FROM (SELECT piece, sum(n) AS n FROM cand GROUP BY piece ORDER BY n DESC, piece LIMIT {size})),
walk(w, begun, ids) AS (SELECT w, 1, CAST([] AS INTEGER[]) FROM short UNION ALL
  SELECT w, begun + l, list_append(ids, id) FROM (SELECT c.w, c.begun, c.ids, c.l, v.id, row_number() OVER (PARTITION BY c.w, c.begun ORDER BY c.l DESC) AS rn
    FROM (SELECT w, begun, ids, unnest(range(1, length(w) - begun + 2)) AS l FROM walk WHERE begun <= length(w)) c JOIN vocab v ON v.piece = CASE WHEN c.begun = 1 THEN substr(c.w, 1, c.l) ELSE '##' || substr(c.w, c.begun, c.l) END) WHERE rn = 1),
spelled AS (SELECT single.w, coalesce(any_value(walk.ids), [1]) AS ids FROM single LEFT JOIN walk ON walk.w = single.w AND walk.begun = length(single.w) + 1 GROUP BY single.w),
tokens AS (SELECT doc_id, coalesce(flatten(list(ids ORDER BY pos) FILTER (ids IS NOT NULL)), []) AS ids FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM worded) JOIN spelled USING (w) GROUP BY doc_id
  UNION ALL SELECT doc_id, [] FROM worded WHERE len(ws) = 0)"""
