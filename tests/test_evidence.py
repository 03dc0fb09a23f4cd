import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskweave.functions import evidence as ev
from riskweave.plans import catalogue
from riskweave.functions import text as tx
from riskweave.plans import fixtures as fx

EXPECTED = {
    1: ["TC_KIMLIK"], 2: [], 3: ["EMAIL"], 4: ["PHONE"], 5: ["IP"], 6: ["CARD"], 7: [], 8: ["IBAN"], 9: ["ADDRESS"], 10: ["NAME"], 11: ["CUSTOMER_ID"], 12: ["API_KEY", "ENV_SECRET"], 13: [], 14: ["BEARER"], 15: ["PRIVATE_KEY"],
    16: ["GITHUB_TOKEN"], 17: ["AWS_KEY"], 18: ["PASSWORD"], 19: ["DB_CREDENTIAL", "EMAIL"], 20: ["EMAIL"], 21: ["PII_MENTION"], 22: ["EXTERNAL_TRANSFER"], 23: ["EMAIL"], 24: [],
}


def found(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string").select("id", ev.evidence(F.col("text")).alias("e"))
    return {r["id"]: r["e"] for r in df.collect()}


def test_types_of_each_fixture_row(spark):
    got = found(spark, fx.TEXTS)
    assert {k: [s["type"] for s in got[k]] for k in EXPECTED} == EXPECTED
    assert got[6][0]["text"] == "4111 1111 1111 1111 " and got[23][0]["start"] == 2 and got[9][0]["text"] == "adres: Deneme Sokak 12"


def test_spans_are_the_text_at_their_offsets_and_ordered(spark):
    text = "x@y.org a@b.org ip 10.0.0.1 😀 card 4111111111111111, token: abcdefghijklmnop1234 é z@w.io"
    got = found(spark, [(1, text)])[1]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in got)
    assert [(s["start"], s["end"]) for s in got] == sorted((s["start"], s["end"]) for s in got) and len(got) == 6


def test_null_and_long_texts(spark):
    got = found(spark, [(1, None), (2, "word " * 50_000 + "a@b.org")])
    assert [len(v or []) for v in got.values()] == [0, 1]


@pytest.mark.parametrize("kind", ["EMAIL", "IP", "PASSWORD", "BEARER"])
def test_one_detector_matches_plain_regex(spark, kind):
    texts = ["a@b.org, c@d.com", "1.2.3.4 5.6.7.8", "password=abcdefg parola: qwerty1", "bearer abcdefghijklmnop1234", "none"]
    want = [[m.group() for m in re.finditer(ev.PATTERNS[kind], t, re.I)] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", ev.spans(F.col("text"), kind).alias("e")).orderBy("id").collect()
    assert [[s["text"] for s in r["e"]] for r in rows] == want


def test_turkish_case_and_guard(spark):
    row = spark.createDataFrame([("IŞIK İ",)], "t string").select(tx.normalize(F.col("t")), tx.normalize_by_language(F.col("t")), tx.guard(F.lit("  \n")), F.length(tx.guard(F.lit("a" * 3000)))).first()
    assert row[0] == "ışık i̇" and row[1] == "ışık i" and row[2] is None and row[3] == 2000


def test_email_runs_are_read_once(spark):
    tokens = ["a", "b1", "_", ".", "-", "%+", ".....", "@", "x.com", "a@x.com", ".org", "é", "ğ", " ", "Z", "--", "c" * 70]
    texts = ["".join(r.choice(tokens) for _ in range(r.randint(1, 25))) for r in map(random.Random, range(3000))]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ev.spans(F.col("t"), "EMAIL").alias("s")).orderBy("i").collect()
    for t, row in zip(texts, found, strict=True):
        assert [(s.text, s.start, s.end) for s in row.s] == [(m.group(), *m.span()) for m in re.finditer(ev.PATTERNS["EMAIL"], t, re.I)], t
    began = time.perf_counter()
    long = spark.createDataFrame([("a." * 200_000 + " @ x@y.org",)], "t string").select(ev.spans(F.col("t"), "EMAIL").alias("s")).first().s
    assert [s.text for s in long] == ["x@y.org"] and time.perf_counter() - began < 20  # 20 KB took 8 s when read from each word boundary


def test_credentials_of_any_text_equal_plain_regex(spark):
    tokens = ["mysql://", "postgres://", "a", "b1", ":", "@", "@@", " ", "/", "x.y", "\n", "é", "mongodb://u:p@h "]
    texts = ["".join(r.choice(tokens) for _ in range(r.randint(1, 20))) for r in map(random.Random, range(3000))]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ev.spans(F.col("t"), "DB_CREDENTIAL").alias("s"), ev.occurs(F.col("t"), "DB_CREDENTIAL").alias("o")).orderBy("i").collect()
    for t, row in zip(texts, found, strict=True):
        want = [(m.group(), *m.span()) for m in re.finditer(ev.PATTERNS["DB_CREDENTIAL"], t, re.I)]
        assert [(s.text, s.start, s.end) for s in row.s] == want and row.o == bool(want), t


# Texts that begin many matches, or run long before they fail, for each detector.
HARD = {
    "TC_KIMLIK": ["1", "1 ", "12345678901"], "EMAIL": ["a.", "a@", "a@b", "a@b.", "@"], "PHONE": ["05", "0532 ", "+90", "5 "], "IP": ["1.", "1.2.3", "255."], "CARD": ["1", "1 ", "1-", "1 -"], "IBAN": ["TR12 0000 ", "TR", "0000 "],
    "ADDRESS": ["adres:", "adres ", "adres: ,", "address=\n "], "NAME": ["ad soyad: a", "full name:", "ad soyad: ab ", "full name "], "CUSTOMER_ID": ["customer id:", "customer id: a-", "customer id "], "API_KEY": ["token=", "token=-", "api_key ", "token:a-"],
    "BEARER": ["Bearer ", "Bearer a", "bearer"], "PRIVATE_KEY": ["-----BEGIN ", "-----BEGIN RSA ", "-"], "GITHUB_TOKEN": ["ghp_", "ghp_a", "ghp_aaaaaaaaaaaaaaaaaaaaaaaa_"], "AWS_KEY": ["AKIA", "AKIAA "], "PASSWORD": ["password:", "password: ", "parola=a,"],
    "DB_CREDENTIAL": ["mysql://a:", "mysql://:", "mysql://", "mysql://a:b@ ", "mysql://a"], "ENV_SECRET": ["KEY", "A_KEY ", "KEY=", "aKEY = ", "TOKEN_"], "PII_MENTION": ["customer ", "TC kimlik numara", "passport number"], "EXTERNAL_TRANSFER": ["gönder", "send", "API'y"],
}


@pytest.mark.parametrize("kind", list(ev.PATTERNS))
def test_every_detector_takes_time_in_proportion_to_the_text(spark, kind):
    cases = [end + unit * (size // len(unit)) + end for unit in HARD[kind] for size in (300_000,) for end in ("", " @ x")]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").repartition(1).cache()
    rows.count()
    began = time.perf_counter()
    rows.select(F.size(ev.spans(F.col("t"), kind)).alias("n"), ev.occurs(F.col("t"), kind).alias("o")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 1.5 * len(cases)  # 160 KB of one of them took 16 s where each start read its run's rest


def test_spans_of_letters_that_fold(spark):
    """Texts skip a detector's pattern by literals of the folded text, which has every letter that the pattern takes for an ASCII one."""
    texts = ["\u017fEND it", "A\u212aIA" + "A" * 16, "TC KİML\u0131K NUMARAsı", "passw\u00f6rd: abcdefgh", "CU\u017fTOMER İD: abcde", "MÜŞTERİ ADI: Ali Veli", "ad\u017fes: somewhere 12", "X_TO\u212aEN=abcdefgh", "ba\u017fic BEARER " + "a" * 16, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    plain = df.select("i", *[F.size(F.regexp_extract_all("t", F.lit(ev._regex(k)), F.lit(0))).alias(k) for k in ev.PATTERNS if k not in ev.VALID]).collect()
    told = df.select("i", F.transform(ev.evidence(F.col("t")), lambda s: s["type"]).alias("types"), *[ev.occurs(F.col("t"), k).alias(k) for k in ev.PATTERNS]).collect()
    for a, b in zip(plain, told, strict=True):
        wanted = {k: max(a[k] or 0, 0) for k in ev.PATTERNS if k not in ev.VALID}
        assert {k: (b.types or []).count(k) for k in wanted} == wanted and {k: bool(b[k]) for k in wanted} == {k: n > 0 for k, n in wanted.items()}
    assert sum(len(r.types or []) for r in told) >= 7


def test_evidence_is_made_once_in_plans(spark):
    plan = lambda q: catalogue.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    once = spark.range(1).select(ev.evidence(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString().count("type, EMAIL")
    assert plan("evidence_chips").count("type, EMAIL") == once > 0
    assert "sha2" not in plan("analyze_documents") and "sha2" not in plan("analyze_trained")
