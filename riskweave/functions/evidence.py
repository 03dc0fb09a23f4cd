"""Evidence spans: nineteen pattern detectors with validators, as column expressions.

A span is struct<type, text, start, end> with half-open code-point offsets.  Spans of one detector never overlap; spans of
different detectors may, and all are kept, ordered by (start, end) and then by declaration.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PII_TYPES, SECRET_TYPES

# The patterns in order of declaration; case-insensitive with Unicode classes.
PATTERNS = {
    "TC_KIMLIK": r"(?<!\d)\d{11}(?!\d)",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?<!\d)(?:\+?90\s?)?(?:0?5\d{2})[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}(?!\d)",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "CARD": r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
    "IBAN": r"\bTR\d{2}(?:[ ]?\d{4}){5}[ ]?\d{2}\b",
    "ADDRESS": r"\b(?:adres|address)\s*[:=]\s*[^\n,;]{8,80}",
    "NAME": r"\b(?:ad soyad|full name|müşteri adı)\s*[:=]\s*[A-Za-zÇĞİÖŞÜ][a-zçğıöşü]+\s+[A-Za-zÇĞİÖŞÜ][a-zçğıöşü]+",
    "CUSTOMER_ID": r"\b(?:müşteri no|customer id)\s*[:=]\s*[A-Za-z0-9-]{5,20}\b",
    "API_KEY": r"\b(?:api[_ -]?key|token)\s*[:=]\s*[A-Za-z0-9_\-]{16,}\b",
    "BEARER": r"\bBearer\s+[A-Za-z0-9._~+/=-]{16,}",
    "PRIVATE_KEY": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "GITHUB_TOKEN": r"\b(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{20,}\b",
    "AWS_KEY": r"\b(?:AKIA|ASIA)[A-Za-z0-9]{16}\b",
    "PASSWORD": r"\b(?:password|parola|şifre)\s*[:=]\s*[^\s,;]{6,}",
    "DB_CREDENTIAL": r"\b(?:postgres|mysql|mongodb)://[^\s:@]+:[^\s@]+@[^\s]+",
    "ENV_SECRET": r"\b[A-Za-z][A-Za-z0-9_]*(?:SECRET|TOKEN|PASSWORD|KEY)\s*=\s*[^\s]{8,}",
    "PII_MENTION": r"\b(?:TC kimlik numara\w*|social security number|passport number|müşteri listesi|customer list)\b",
    "EXTERNAL_TRANSFER": r"\b(?:gönder\w*|aktar\w*|send|upload|exfiltrate|API'ye)\b",
}
# What every match contains: literals of the folded text (see folded), one of each list; and a pattern that is cheap to refuse.
# Texts without them skip the detector's pattern.
NEEDS = {
    "EMAIL": (["@"],), "IP": (["."],), "ADDRESS": ([":", "="], ["adres", "addres"]), "NAME": ([":", "="], ["ad soyad", "full name", "müşteri adi"]), "CUSTOMER_ID": ([":", "="], ["müşteri no", "customer id"]),
    "API_KEY": ([":", "="], ["api", "token"]), "BEARER": (["bearer"],), "PRIVATE_KEY": (["-----"],), "GITHUB_TOKEN": (["_"], ["ghp_", "gho_", "ghs_", "ghu_"]), "AWS_KEY": (["akia", "asia"],),
    "PASSWORD": ([":", "="], ["password", "parola", "şifre"]), "DB_CREDENTIAL": (["://"], ["postgres", "mysql", "mongodb"]), "ENV_SECRET": (["="], ["secret", "token", "password", "key"]),
    "PII_MENTION": (["tc kimlik numara", "social security number", "passport number", "müşteri listesi", "customer list"],), "EXTERNAL_TRANSFER": (["gönder", "aktar", "send", "upload", "exfiltrate", "api'ye"],),
}
SHAPES = {"TC_KIMLIK": "[0-9]{11}", "PHONE": r"(?U)5\d{2}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}", "IP": r"[0-9]\.[0-9]{1,3}\.[0-9]", "CARD": r"(?U)(?:\d[ -]?){13}", "IBAN": r"(?U)[Rr]\d{2} ?\d{4}"}
# What a match may be besides: runs without the @ that a credential needs are matched whole and left out afterwards, or each
# start in a run would read the run's rest again.
SPARE = {"DB_CREDENTIAL": r"\b(?:postgres|mysql|mongodb)://[^\s:@]++:[^\s@]*+(?!@\S)"}
# Where a match may begin, said more narrowly than the pattern does, so that a run of characters isn't read again from each
# of its word boundaries: a boundary that follows another of the same run gives no match if that one gave none.
BEGINS = {"EMAIL": r"\b(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G|(?![.%+-])(?<!\b[.%+-]{1,4})|(?=[.%+-])(?<!\b[A-Za-z0-9._%+-]{1,64}))"}


def _regex(kind: str) -> str:
    pattern = BEGINS[kind] + PATTERNS[kind].removeprefix(r"\b") if kind in BEGINS else PATTERNS[kind]
    return f"(?iU)(?:{SPARE[kind]})|(?:{pattern})" if kind in SPARE else f"(?iU){pattern}"


def is_ip(value: Column) -> Column:
    """Four octets up to 255 without leading zeros."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return value.rlike(rf"^{octet}(\.{octet}){{3}}$")


def is_card(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is divisible by ten; other characters are skipped."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_national_id(value: Column) -> Column:
    """Eleven digits, the first not 0, with two check digits; the first check takes a non-negative modulus."""
    digit = lambda i: F.substring(value, i + 1, 1).cast("int")
    total = lambda at: reduce(lambda a, b: a + b, [digit(i) for i in at])
    checks = (digit(0) != 0) & (F.pmod(total(range(0, 9, 2)) * 7 - total(range(1, 8, 2)), F.lit(10)) == digit(9)) & (F.pmod(total(range(10)), F.lit(10)) == digit(10))
    return F.when(value.rlike("^[0-9]{11}$"), checks).otherwise(F.lit(False))


VALID = {"IP": is_ip, "CARD": is_card, "TC_KIMLIK": is_national_id, "DB_CREDENTIAL": lambda value: F.contains(value, F.lit("@"))}


STEP = 256  # elements whose sums are made in one go


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums(lengths: Column) -> Column:
    """struct<at, total>: for each element the sum of those before it, and the sum of all."""
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("total"))
    return F.aggregate(lengths, none, lambda s, x: F.struct(F.array_append(s["at"], s["total"]).alias("at"), (s["total"] + x).alias("total")))


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it, by blocks of STEP, as an appended array is copied each time."""

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(STEP)), lambda i: _sums(F.slice(xs, i, F.lit(STEP))))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, _sums(F.transform(bs, lambda b: b["total"]))["at"], lambda b, base: F.transform(b["at"], lambda x: x + base))))

    return _let(lengths, whole)


def folded(text: Column) -> Column:
    """Lower case in which every letter that patterns take for an ASCII one is that: dotted and dotless i, long s, the sign of kelvins."""
    plain = text
    for other, letter in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        plain = F.replace(plain, F.lit(other), F.lit(letter))
    return F.lower(plain)


def _needed(text: Column, lower: Column, kind: str) -> Column | None:
    """Whether the text holds what every match of the detector contains; null if the detector says nothing of it."""
    tests = [reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in any_of]) for any_of in NEEDS.get(kind, ())]
    tests += [text.rlike(SHAPES[kind])] if kind in SHAPES else []
    return reduce(lambda a, b: a & b, tests)


def possible(text: Column, kind: str, lower: Column | None = None) -> Column:
    """Whether the detector's pattern occurs, in texts in which a valid span may be; literals and plain shapes are looked for first."""
    if lower is None:
        return _let(F.struct(text.alias("text"), folded(text).alias("lower")), lambda x: possible(x["text"], kind, x["lower"]))
    return _needed(text, lower, kind) & text.rlike(_regex(kind))


def _matches(text: Column, kind: str, n: int, lower: Column) -> Column:
    """struct<n, type, values, gaps> of one detector: its matches and the texts before and between them; null without any."""
    pattern = _regex(kind)
    found = F.struct(F.lit(n).alias("n"), F.lit(kind).alias("type"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(possible(text, kind, lower), found)


def _placed(x: Column) -> Column:
    """array<struct<start, end, n, type, text>> of one detector's matches; work grows with the text and its matches."""
    values = F.zip_with(x["values"], F.slice(x["gaps"], F.lit(1), F.size(x["values"])), lambda v, gap: F.struct(v.alias("text"), F.length(gap).alias("gap"), F.length(v).alias("length")))

    def span(v: Column, before: Column) -> Column:
        start = before + v["gap"]
        return F.struct(start.alias("start"), (start + v["length"]).alias("end"), x["n"].alias("n"), x["type"].alias("type"), v["text"].alias("text"))

    return _let(values, lambda vs: F.zip_with(vs, _before(F.transform(vs, lambda v: v["gap"] + v["length"])), span))


def occurs(text: Column, kind: str, lower: Column | None = None) -> Column:
    """Whether the detector has a span, without placing it."""
    if kind not in VALID:
        return possible(text, kind, lower)
    return F.when(possible(text, kind, lower), F.exists(F.regexp_extract_all(text, F.lit(_regex(kind)), F.lit(0)), VALID[kind])).otherwise(F.lit(False))


def occurs_any(text: Column, kinds: tuple[str, ...]) -> Column:
    """Whether any of the detectors has a span; the first that has ends the search."""
    first = sorted(kinds, key=lambda k: (k in SHAPES, k in VALID))
    any_of = _let(F.struct(text.alias("text"), folded(text).alias("lower")), lambda x: reduce(lambda a, b: a | b, [occurs(x["text"], k, x["lower"]) for k in first]))
    return F.coalesce(any_of, F.lit(False))


def evidence(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """Spans of the detectors ordered by (start, end, declaration); null texts have none."""
    both = F.struct(text.alias("text"), folded(text).alias("lower"))
    found = F.filter(_let(both, lambda x: F.array(*[_matches(x["text"], k, n, x["lower"]) for n, k in enumerate(kinds)])), lambda x: x.isNotNull())
    every = F.flatten(F.transform(found, _placed))
    if any(k in VALID for k in kinds):
        every = F.filter(every, lambda s: reduce(lambda chain, k: chain.when(s["type"] == k, VALID[k](s["text"])), VALID, F).otherwise(F.lit(True)))
    return F.transform(F.array_sort(every), lambda s: F.struct(s["type"], s["text"], s["start"], s["end"]))


def spans(text: Column, kind: str) -> Column:
    """All spans of one detector, in order."""
    return evidence(text, (kind,))


def has_type(spans_: Column, types: tuple[str, ...]) -> Column:
    return F.exists(spans_, lambda s: s["type"].isin(*types))


def has_all_types(spans_: Column, types: tuple[str, ...]) -> Column:
    """Whether the types are a subset of those found."""
    return F.size(F.array_except(F.array(*map(F.lit, types)).cast("array<string>"), F.transform(spans_, lambda s: s["type"]))) == 0


def has_pii(spans_: Column) -> Column:
    return has_type(spans_, PII_TYPES)


def has_secret(spans_: Column) -> Column:
    return has_type(spans_, SECRET_TYPES)


def has_transfer(spans_: Column, external_api: Column | None = None) -> Column:
    seen = has_type(spans_, ("EXTERNAL_TRANSFER",))
    return seen if external_api is None else seen | F.coalesce(external_api, F.lit(False))


def chips(spans_: Column, most: int = 12, width: int = 80) -> Column:
    """The first spans as short labels for display."""
    return F.transform(F.slice(spans_, 1, most), lambda s: F.concat(s["type"], F.lit(" · "), F.substring(s["text"], 1, width)))


# --- the same spans as SQL text, for SQL functions -------------------------------------------------------------------------
def _sql_let(value: str, name: str, use: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _sql_sums(lengths: str) -> str:
    return f"aggregate({lengths}, named_struct('at', CAST(array() AS ARRAY<INT>), 'total', 0), (s, n) -> named_struct('at', array_append(s.at, s.total), 'total', s.total + n))"


def _sql_before(lengths: str) -> str:
    blocks = f"transform(sequence(1, greatest(size(ys), 1), {STEP}), i -> {_sql_sums(f'slice(ys, i, {STEP})')})"
    placed = f"flatten(zip_with(bs, {_sql_sums('transform(bs, b -> b.total)')}.at, (b, base) -> transform(b.at, y -> y + base)))"
    return _sql_let(lengths, "ys", _sql_let(blocks, "bs", placed))


def _sql_digits(at: range, value: str) -> str:
    return "(" + " + ".join(f"CAST(substr({value}, {i + 1}, 1) AS INT)" for i in at) + ")"


def tc_valid_sql(value: str) -> str:
    """is_national_id as SQL."""
    first = f"CAST(substr({value}, 1, 1) AS INT) <> 0 AND pmod({_sql_digits(range(0, 9, 2), value)} * 7 - {_sql_digits(range(1, 8, 2), value)}, 10) = {_sql_digits(range(9, 10), value)}"
    return f"CASE WHEN {value} RLIKE '^[0-9]{{11}}$' THEN {first} AND pmod({_sql_digits(range(10), value)}, 10) = {_sql_digits(range(10, 11), value)} ELSE false END"


def _sql_valid(kind: str, value: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return {"IP": f"{value} RLIKE r'^{octet}([.]{octet}){{3}}$'", "CARD": f"length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits})", "TC_KIMLIK": tc_valid_sql(value), "DB_CREDENTIAL": f"contains({value}, '@')"}[kind]


def evidence_sql(text: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> str:
    """evidence() as a SQL expression over the SQL value `text`: an array of struct<start, end, n, type, text> in order."""
    found = []
    for n, kind in enumerate(kinds):
        pattern = f'r"{_regex(kind)}"'
        need = f"{text} RLIKE r'{SHAPES[kind]}' AND " if kind in SHAPES else f"contains({text}, '{NEEDS[kind][0][0]}') AND " if len(NEEDS[kind][0]) == 1 and not NEEDS[kind][0][0].isalpha() else ""
        found.append(f"CASE WHEN {need}{text} RLIKE {pattern} THEN named_struct('n', {n}, 'type', '{kind}', 'values', regexp_extract_all({text}, {pattern}, 0), 'gaps', split({text}, {pattern}, -1)) END")
    values = "zip_with(x.values, slice(x.gaps, 1, size(x.values)), (v, gap) -> named_struct('text', v, 'gap', length(gap), 'length', length(v)))"
    span = "named_struct('start', p + v.gap, 'end', p + v.gap + v.length, 'n', x.n, 'type', x.type, 'text', v.text)"
    placed = _sql_let(values, "vs", f"zip_with(vs, {_sql_before('transform(vs, v -> v.gap + v.length)')}, (v, p) -> {span})")
    every = f"flatten(transform(filter(array({', '.join(found)}), f -> f IS NOT NULL), x -> {placed}))"
    checks = " ".join(f"WHEN z.type = '{k}' THEN {_sql_valid(k, 'z.text')}" for k in kinds if k in VALID)
    return f"array_sort(filter({every}, z -> CASE {checks} ELSE true END))" if checks else f"array_sort({every})"
