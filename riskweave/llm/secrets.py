"""Secret scan: candidate strings, and a random forest trained on labelled findings that removes false positives.

Candidates are long runs of key characters with a digit, values assigned to credential words by = or :, quoted or not,
of any length and with or without digits, and private key blocks; those that overlap are one candidate.  The forest sees
each candidate's length, transitions between character classes, the share that words of a dictionary cover, the path
(source) it came from and the words around it.  The labelled findings are given, or else drawn by rule from a seed, real
secrets and look-alikes side by side.  The dictionary is the whole words in a tokenizer's vocabulary file, given by path.

Defined results: null and empty texts have no candidates; long texts are scanned whole; every occurrence is its own row,
and each row is scanned by itself, also repeated ones and those without an id; offsets count characters; a null source is
an empty path; a score of KEEP is a secret; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that announce or belie a credential, words that keys are made of by hand, and path parts of samples.
CREDENTIAL = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "bearer", "private")
SAMPLE = ("example", "sample", "dummy", "placeholder", "test", "fake", "changeme", "your", "xxxx", "todo")
HARMLESS = ("commit", "sha", "sha256", "md5", "checksum", "digest", "uuid", "guid", "version", "hash", "id", "revision", "file", "image", "card", "phone", "order", "ref")
SYLLABLES = ("the", "ing", "ion", "ent", "pass", "word", "user", "name", "key", "my", "admin", "example", "value", "change", "me", "here", "your", "secret", "token", "data", "file", "test", "path", "com", "org", "www", "http", "mail", "img", "doc", "en", "er", "an", "re", "on", "at", "ed", "or", "es", "st")
RUN = re.compile(r"[A-Za-z0-9+/_=.\-@]{12,}")
FIRST = re.compile(r"(?:^|=)([A-Za-z0-9+/_\-@])")
ASSIGNED = re.compile(r"^([A-Za-z_]*)=(.+)$")
WORDS = re.compile("|".join(map(re.escape, CREDENTIAL)).replace("_", "[_-]?"), re.IGNORECASE)
NAME_END = re.compile(r"[A-Za-z0-9_.\-]*")
SIGN = re.compile(r"""["']?[ \t]*(?::=|=>|={1,2}|:)[ \t]*(?:(?:bearer|basic)[ \t]+)?""", re.IGNORECASE)
QUOTED = {q: re.compile(rf"[^\r\n{q}]*") for q in "\"'`"}
BARE = re.compile(r"""[^\s"'`;,&<>]+""")
BEGIN = re.compile(r"-----BEGIN (?:[A-Z]+ )*?PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"(?=(-----END (?:[A-Z]+ )*?PRIVATE KEY(?: BLOCK)?-----))")
BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\-]*")
KEY_ONLY = re.compile(r"[A-Za-z0-9+/=\s]*")
KEEP = 0.5
LONGEST = 14  # letters of a dictionary word


def dictionary(path: str) -> frozenset[str]:
    """Whole lower-case words of four letters or more in a rank file: pieces that begin with a space."""
    with open(path, "rb") as lines:
        pieces = (base64.b64decode(line.split()[0]) for line in lines)
        return frozenset(p[1:].decode() for p in pieces if 5 <= len(p) <= LONGEST + 1 and p[:1] == b" " and p[1:].isalpha() and p[1:].islower() and p.isascii())


def _transitions(s: str) -> float:
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in s]
    return sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / max(len(s) - 1, 1)


def features(value: str, before: str, after: str, path: str, words: frozenset[str] = frozenset(SYLLABLES)) -> list[float]:
    low, near = value.lower(), before.lower()
    covered, at = 0, 0
    while at < len(low):
        hit = next((n for n in range(min(LONGEST, len(low) - at), 1, -1) if low[at : at + n] in words), 0)
        covered += hit
        at += hit or 1
    n = max(len(value), 1)
    counts = np.unique(np.frombuffer(value.encode("utf-16-le"), dtype=np.uint16), return_counts=True)[1] / n
    last = re.findall(r"[a-z0-9_]+", near)[-2:]
    return [
        len(value), _transitions(value), covered / n, float(-(counts * np.log2(counts)).sum()),
        sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, float(all(c in "0123456789abcdef" for c in value)),
        sum(not c.isalnum() for c in value) / n, float(value.startswith(("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xox", "-----BEGIN"))),
        float(any(w in x for x in last for w in CREDENTIAL)), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(any(x in HARMLESS for x in last)),
        float(any(w in low or w in near[-24:] or w in after.lower()[:16] for w in SAMPLE)), float(any(w in path.lower() for w in SAMPLE)), float("@" in value), float(value.count(".") + value.count("/")),
    ]


def candidates(text: str | None) -> Iterator[tuple[int, int]]:
    """Places of candidate strings in order, disjoint, without an announcing name and end marks."""
    last = None
    for start, end, whole in sorted([*((a, b, False) for a, b in _runs(text or "")), *((a, b, True) for a, b in [*_assigned(text or ""), *_blocks(text or "")])]):
        if last is not None and start < last[1]:  # an assigned value in a run is without the name before it
            last = last[0] if last[2] or not whole else start, max(last[1], end), last[2] or whole
            continue
        if last is not None:
            yield last[:2]
        last = start, end, whole
    if last is not None:
        yield last[:2]


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters, from the first that may begin one at the run's start or after =."""
    for m in RUN.finditer(text):
        first = FIRST.search(m.group())
        if not first or len(run := m.group()[first.start(1) :]) < 12:
            continue
        start, end = m.start() + first.start(1), m.end()
        if named := ASSIGNED.match(run):
            start += len(named[1]) + 1
        while end > start and text[end - 1] in ".=-":
            end -= 1
        if end - start >= 8 and any(c.isdigit() for c in text[start:end]):
            yield start, end


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys from their first line to the last, or as far as key characters go."""
    if "PRIVATE KEY" not in text:
        return
    ends = [m.span(1) for m in END.finditer(text)]
    at, reach, next_end = 0, 0, 0
    while m := BEGIN.search(text, at):
        if m.end() >= reach:  # first lines within one body share its reach
            reach = BODY.match(text, m.end()).end()
        while next_end < len(ends) and ends[next_end][0] < m.end():
            next_end += 1
        if next_end < len(ends) and ends[next_end][0] <= reach:
            at = ends[next_end][1]
        else:
            at = KEY_ONLY.match(text, m.end()).end()
        yield m.start(), m.start() + len(text[m.start() : at].rstrip())


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values after a credential word, whatever else its name holds, and = or :; one within an earlier value that isn't quoted is a part of that.

    Words of one name share its end, and so its value: a name is read once, as are the blanks around the sign.
    """
    reach, name = 0, -1
    for word in WORDS.finditer(text):
        if word.end() <= name:
            continue
        name = NAME_END.match(text, word.end()).end()
        sign = SIGN.match(text, name)
        if not sign:
            continue
        start = sign.end()
        if quoted := QUOTED.get(text[start : start + 1]):
            end = quoted.match(text, start + 1).end()
            if end > start + 1 and text[end : end + 1] == text[start]:
                yield start + 1, end
                continue
        if text[start : start + 1] in ("'", '"'):
            start += 1
        if start < reach:
            continue
        found = BARE.match(text, start)
        if not found:
            continue
        reach = end = found.end()
        while end > start and text[end - 1] in ".,:)]}":
            end -= 1
        if end > start:
            yield start, end


def labelled_findings(rows: int = 3000, seed: int = 3, words: frozenset[str] = frozenset()) -> list[tuple[str, str, str, str, int]]:
    """(value, text before, text after, path, 1 for a secret), half of either kind, drawn by rule."""
    random = np.random.default_rng(seed)
    of = lambda alphabet, n: "".join(random.choice(list(alphabet), n))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    known = sorted(words)
    word = lambda: known[int(random.integers(len(known)))] if known else of("aeiou", 1).join(random.choice(list(SYLLABLES), 3))
    block = lambda body, kind="RSA ": f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
    digits, length = "0123456789", lambda a, b: int(random.integers(a, b))
    named = lambda: f"{random.choice(CREDENTIAL)}{random.choice(['=', ' = ', ': ', ' = "', '="'])}"
    real = [
        lambda: (of(hexa, length(16, 65)), f"{word()} {named()}", "src"),
        lambda: (of(mixed, length(14, 48)), f"{word()} {named()}", "config"),
        lambda: (("AKIA" if random.random() < 0.7 else "ASIA") + of(upper, 16), f"{word()} ", "app"),
        lambda: ("ghp_" + of(mixed, 36), f"{word()} ", "ci"),
        lambda: (of(mixed, length(6, 14)) + of("!#$%*?", length(0, 2)), f"{word()} {named()}", "config"),
        lambda: (of(mixed[:52], length(16, 48)), f"{word()} {named()}", "src"),
        lambda: (f"{word()[: length(4, 8)]}{of(digits, length(1, 4))}{of('!#$%*?', length(0, 2))}", f"{word()} {named()}", "config"),
        lambda: (f"{word()}{word()}"[: length(8, 16)].translate(str.maketrans({c: d for c, d in zip("aeios", "43105", strict=True) if random.random() < 0.4})) + of(digits, length(1, 4)), f"{word()} {named()}{random.choice(['', chr(39)])}", "config"),
        lambda: (block("\n".join(of(mixed + "+/", 64) for _ in range(length(1, 20))), random.choice(["RSA ", "EC ", "OPENSSH ", ""])), f"{word()}\n", random.choice(["src", "config"])),
        lambda: (f"{random.choice(['sk-', 'xoxb-', 'gho_', ''])}{of(mixed, length(20, 44))}", f"{word()} {named()}{random.choice(['', 'Bearer '])}", random.choice(["src", "config", "ci"])),
    ]
    false = [
        lambda: (of(hexa, length(32, 65)), f"{word()} {random.choice(HARMLESS)}{random.choice([' ', ': ', '='])}", "src"),
        lambda: ("-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)), f"{random.choice([word(), 'uuid', 'id'])} ", "docs"),
        lambda: (f"{word()}{random.choice(['', '.', '-', '_'])}{word()}{of(digits, length(1, 4))}", f"{word()} ", "docs"),
        lambda: (f"{word()}.{of(digits, 2)}@mail{of(digits, 1)}.example.com", f"{word()} ", "src"),
        lambda: (f"/{word()}/{word()}/{word()}{of(digits, 2)}.txt", f"{word()} ", "docs"),
        lambda: (of(digits, length(12, 20)), f"{word()} ", "src"),
        lambda: ("-".join(of(digits, 3) for _ in range(4)), f"{word()} ", "src"),
        lambda: (f"{random.choice(['changeme', 'yourtoken', 'examplekey', 'testpassword', 'xxxxxxxxxxxx'])}{of(digits, length(1, 5))}", f"{word()} {named()}", "src"),
        lambda: (of(hexa, length(16, 41)), f"{word()} {named()}", random.choice(["test/fixtures", "examples/sample"])),
        lambda: ("AKIA" + of(upper, 9) + "EXAMPLE", f"{word()} ", "docs"),
        lambda: (random.choice(["required", "none", "None", "NULL", "null", "nil", "True", "true", "False", "false", "undefined", "string", "the", "a", "your", word(), of(mixed[:26], length(2, 9))]), f"{word()} {named()}", random.choice(["src", "docs", "config"])),
        lambda: (block(random.choice(["...", "your key here", word()])), f"{word()}\n", random.choice(["docs", "examples"])),
        lambda: (f"{word()}{random.choice(['', '_'])}{random.choice(['api', word()])}{random.choice(['_key', '_here', 'name', ''])}{of(digits, length(0, 3))}", f"{word()} {named()}", random.choice(["docs", "src"])),
        lambda: ("-".join([word(), *(str(random.integers(0, 3000)) for _ in range(length(1, 3)))]), f"{word()} ", "src"),
        lambda: (random.choice(["${%s}", "$%s", "{{%s}}", "os.environ[%s]", "get_%s()", "self.%s", "config.%s"]) % word(), f"{word()} {named()}", random.choice(["src", "config"])),
    ]
    out = []
    for i in range(rows):
        makers = (false, real)[i % 2]
        value, before, path = makers[int(random.integers(len(makers)))]()
        out.append((value, before, f" {word()}", path, i % 2))
    return out


class Forest:
    """Random forest of binary trees over dense features, trained on bootstrap samples with random feature subsets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 9, least: int = 4, seed: int = 1):
        random = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rows, depth, least, random) for rows in (random.integers(0, len(y), len(y)) for _ in range(trees))]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, least: int, random: np.random.Generator) -> np.ndarray:
        nodes: list[list[float]] = []

        def grow(at: np.ndarray, left_depth: int) -> int:
            me = len(nodes)
            share = float(y[at].mean())
            nodes.append([-1, 0.0, share, 0, 0])
            if left_depth == 0 or len(at) < 2 * least or share in (0.0, 1.0):
                return me
            best = (share * (1 - share) * len(at) - 1e-9, -1, 0.0)
            for f in random.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)].tolist():
                v = x[at, f]
                for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))).tolist():
                    low = v <= cut
                    n = int(low.sum())
                    if least <= n <= len(at) - least:
                        p, q = y[at[low]].mean(), y[at[~low]].mean()
                        impurity = p * (1 - p) * n + q * (1 - q) * (len(at) - n)
                        if impurity < best[0]:
                            best = (impurity, f, cut)
            if best[1] >= 0:
                low = x[at, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][3] = grow(at[low], left_depth - 1)
                nodes[me][4] = grow(at[~low], left_depth - 1)
            return me

        grow(rows, depth)
        return np.array(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the share of secrets in the leaf each row falls into."""
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := tree[at, 0] >= 0).any():
                f = tree[at, 0].astype(np.int64).clip(0)
                go = np.where(x[np.arange(len(x)), f] <= tree[at, 1], tree[at, 3], tree[at, 4]).astype(np.int64)
                at = np.where(inner, go, at)
            total += tree[at, 2]
        return total / len(self.trees)


def trained(findings: list[tuple[str, str, str, str, int]], words: frozenset[str] = frozenset(SYLLABLES)) -> Forest:
    return Forest(np.array([features(*f[:4], words) for f in findings]), np.array([f[4] for f in findings], dtype=float))


def _scan(text: str | None, path: str, forest: Forest, words: frozenset[str]) -> list[tuple[int, int, float]]:
    places = list(candidates(text))
    if not places:
        return []
    scores = forest.score(np.array([features(text[a:b], text[max(0, a - 48) : a], text[b : b + 24], path, words) for a, b in places]))
    return [(a, b, float(s)) for (a, b), s in zip(places, scores, strict=True)]


def _state(docs: DataFrame, findings: list | None, dictionary_path: str | None):
    words = dictionary(dictionary_path) if dictionary_path else frozenset()
    forest = trained(labelled_findings(words=words) if findings is None else findings, words or frozenset(SYLLABLES))
    return docs.sparkSession.sparkContext.broadcast((forest.trees, words or frozenset(SYLLABLES)))


def _forest(trees: list[np.ndarray]) -> Forest:
    forest = Forest.__new__(Forest)
    forest.trees = trees
    return forest


def secret_findings(docs: DataFrame, *, findings: list | None = None, dictionary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, start, end, value_sha256, score and is_secret (score of at least KEEP) of every candidate."""
    shared, kind = _state(docs, findings, dictionary_path), docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        forest, words = _forest(shared.value[0]), shared.value[1]
        for frame in frames:
            rows = [(key, a, b, hashlib.sha256(text[a:b].encode()).hexdigest(), s, s >= KEEP) for key, text, path in frame.itertuples(index=False) for a, b, s in _scan(text, path or "", forest, words)]
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "value_sha256", "score", "is_secret"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string"), F.col(path_col).cast("string")).mapInPandas(run, f"{id_col} {kind}, start int, end int, value_sha256 string, score double, is_secret boolean")


def redact_secrets(docs: DataFrame, *, mark: str = "[SECRET]", findings: list | None = None, dictionary_path: str | None = None, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with every secret in the text replaced by mark; columns and their order stay."""
    shared = _state(docs, findings, dictionary_path)

    @F.pandas_udf("string")
    def clean(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        forest, words = _forest(shared.value[0]), shared.value[1]
        for texts, paths in frames:
            out = []
            for text, path in zip(texts, paths, strict=True):
                secret = [(a, b) for a, b, s in _scan(text, path or "", forest, words) if s >= KEEP]
                cuts = [0, *(x for place in secret for x in place), None]
                out.append(mark.join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if secret else text)
            yield pd.Series(out, dtype=object)

    return docs.select(*[clean(F.col(text_col).cast("string"), F.col(path_col).cast("string")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
