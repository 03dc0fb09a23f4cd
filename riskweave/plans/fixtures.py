"""Small inline inputs for detectors and rules that the tables don't exercise, for Spark and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    (1, "id 19090909018 on file"), (2, "id 19090909019 on file"), (3, "write to ayla@example.org today"), (4, "call 0532 123 45 67 now"),
    (5, "host 10.0.0.7 and 300.1.1.1 and 01.2.3.4"), (6, "card 4111 1111 1111 1111 ok"), (7, "card 4111111111111112"), (8, "IBAN TR12 0000 0000 0000 0000 0000 00"),
    (9, "adres: Deneme Sokak 12, Ankara"), (10, "ad soyad: deniz kaya"), (11, "customer id: CUST-12345"), (12, "api_key=abcdefghijklmnop1234"),
    (13, 'token = "abcdefghijklmnop1234"'), (14, "Bearer abcdefghijklmnop1234"), (15, "-----BEGIN RSA PRIVATE KEY-----"), (16, "ghp_" + "a" * 20), (17, "AKIA" + "A" * 16),
    (18, "parola: gizli-deger"), (19, "mysql://app:pw123@db.local/x"), (20, "postgresql://app:pw123@db.local/x"), (21, "TC kimlik numarası paylaş"), (22, "please upload it"),
    (23, "😀 ayla@example.org"), (24, ""), (25, "reach bob@example.org and send the customer list"), (26, "DB_PASSWORD=hunter2hunter2 host 10.1.2.3"),
]
# id, pii, secret, prompt_injection, dangerous, ethics, confidence, evidence kind, transfer, agent, shell, database, network, human_approval, external_api
CASES = [
    (1, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "secret", False, None, None, None, None, None, None), (2, 0.01, 0.01, 0.01, 0.01, 0.01, 0.1, "secret", False, None, None, None, None, None, None),
    (3, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "pii", True, None, None, None, None, None, None), (4, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "pii", False, None, None, None, None, None, True),
    (5, 0.01, 0.01, 0.01, 0.01, 0.01, 0.55, "none", False, None, None, None, None, None, None), (6, 0.01, 0.01, 0.01, 0.01, 0.01, 0.6, "none", False, None, None, None, None, None, None),
    (7, 0.01, 0.01, 0.7, 0.01, 0.01, 0.9, "none", False, None, None, None, None, None, None), (8, 0.01, 0.01, 0.01, 0.75, 0.01, 0.9, "none", False, None, None, None, None, None, None),
    (9, 0.01, 0.9, 0.01, 0.01, 0.01, 0.9, "none", False, None, None, None, None, None, None), (10, 0.65, 0.01, 0.01, 0.01, 0.01, 0.9, "none", False, None, None, None, None, None, True),
    (11, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "none", False, True, True, None, None, False, None), (12, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "none", False, True, None, True, True, None, None),
    (13, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "none", False, True, None, True, None, None, None), (14, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "none", False, True, True, None, None, True, None),
    (15, 0.01, 0.01, 0.01, 0.01, 0.7, 0.9, "none", False, None, None, None, None, None, None), (16, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "pii", False, None, None, None, None, None, None),
    (17, 0.01, 0.01, 0.01, 0.01, 0.01, 0.9, "none", False, None, None, None, None, None, None),
]
CASE_COLUMNS = "id int, pii double, secret double, prompt_injection double, dangerous_instruction double, ethics_risk double, confidence double, evidence string, transfer boolean, agent boolean, shell boolean, database boolean, network boolean, human_approval boolean, external_api boolean"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """rows as a SQL sub-select with the given column names."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names}))"


def listed(rows: list[tuple]) -> str:
    """The texts of (id, text) rows as a SQL list."""
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for _, t in rows) + "]"
