"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length column.

The pairwise term of features x with factor rows v is half of |sum x v|^2 - sum |x v|^2, so a text is scored in time linear
in its features.  The machine is fitted on a bounded sample of labelled rows.

Defined results: null and empty texts have the structure of no words; a null length counts as the text's own; without
labelled rows of both kinds every score is the share of good rows (1 without rows); every row is scored by itself, also
repeated ones and those with a null id, which teach nothing; of rows of one labelled id one is learned from; texts of any
length are scored whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import MEMO_BYTES, MEMO_WORDS
from .training import SAMPLE_ROWS, labelled_sample

_LETTERS = [c for c in range(256) if chr(c).isascii() and chr(c).isalpha()]
_UPPER = [c for c in range(65, 91)]
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_DIGITS = [c for c in range(48, 58)]
_REPEATED_MARKS = [ord(c) for c in "!#$%&*|"]
STATISTICS = 14


class Features:
    """Sparse features of a text: (bucket indices, values), and its structure statistics."""

    def __init__(self, buckets: int):
        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                h = zlib.crc32(word) % buckets
                if len(word) <= MEMO_BYTES:
                    if len(self) >= MEMO_WORDS:
                        self.clear()
                    self[word] = h
                return h

        self._bucket = Memo().__getitem__

    def __call__(self, text: str | None, declared: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = text or ""
        raw = text.encode()
        words = raw.lower().split()
        n = len(words)
        ids, counts = np.unique(np.fromiter(map(self._bucket, words), dtype=np.int64, count=n), return_counts=True)
        by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        size, letters = max(len(raw), 1), max(int(by_byte[_LETTERS].sum()), 1)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        pairs = len(set(zip(words, words[1:], strict=False)))
        declared = len(text) if declared is None or not np.isfinite(declared) else max(float(declared), 0.0)
        statistics = np.array([
            np.log1p(n), np.log1p(declared), len(raw) / max(n, 1) / 10, by_byte[_UPPER].sum() / letters,
            by_byte[_MARKS].sum() / size * 5, by_byte[_DIGITS].sum() / size * 5, by_byte[_REPEATED_MARKS].sum() / size * 10,
            len(set(words)) / max(n, 1), counts.max() / n if n else 0.0, again / max(n - 1, 1), pairs / max(n - 1, 1),
            1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), len(zlib.compress(raw, 1)) / size,
        ])
        return ids, np.sqrt(counts / max(n, 1)), statistics


class Machine:
    """A fitted factorisation machine; score() is linear in the number of features."""

    def __init__(self, buckets: int, factors: int, seed: int = 11):
        random = np.random.default_rng(seed)
        size = buckets + STATISTICS
        self.buckets, self.constant = buckets, None
        self.bias, self.w = 0.0, np.zeros(size, dtype=np.float32)
        self.v = (random.standard_normal((size, factors)) * 0.05).astype(np.float32)
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def inputs(self, ids: np.ndarray, values: np.ndarray, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dense = np.clip((statistics - self.mean) / self.scale, -6, 6)
        return np.concatenate([ids, np.arange(self.buckets, self.buckets + STATISTICS)]), np.concatenate([values, dense]).astype(np.float32)

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        weighted = self.v[at] * x[:, None]
        pairwise = 0.5 * float((weighted.sum(axis=0) ** 2 - (weighted**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.w[at] @ x) + pairwise, -30, 30))))


def fit(sample: pd.DataFrame, *, buckets: int = 1 << 14, factors: int = 6, epochs: int = 6, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Machine:
    machine, y = Machine(buckets, factors, seed), sample["y"].to_numpy(dtype=np.float32)
    if not len(y) or y.min() == y.max():
        machine.constant = float(y.mean()) if len(y) else 1.0
        return machine
    features = Features(buckets)
    rows = [features(t, c) for t, c in zip(sample["text"], sample["n_chars"], strict=True)]
    statistics, weight = np.array([r[2] for r in rows]), sample["weight"].to_numpy(dtype=np.float32)
    machine.mean, machine.scale = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
    rows = [machine.inputs(*r) for r in rows]
    random = np.random.default_rng(seed)
    params = [machine.w, machine.v]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    b1 = b2 = 0.0
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for part in (order[i : i + batch] for i in range(0, len(order), batch)):
            at, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])[:-1]])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            vx = machine.v[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            out = machine.bias + np.add.reduceat(machine.w[at] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) * weight[part] / weight[part].sum()
            slope = error[owner] * x
            touched, slot = np.unique(at, return_inverse=True)
            gw = np.bincount(slot, weights=slope, minlength=len(touched))
            pull = slope[:, None] * (sums[owner] - vx)
            gv = np.column_stack([np.bincount(slot, weights=pull[:, k], minlength=len(touched)) for k in range(factors)])
            step += 1
            for p, (m, s), g in zip(params, moments, (gw, gv), strict=True):
                g = g.astype(np.float32) + decay * p[touched]
                m[touched] = 0.9 * m[touched] + 0.1 * g
                s[touched] = 0.99 * s[touched] + 0.01 * g * g
                p[touched] -= rate * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.99**step)) + 1e-6)
            b1, b2 = 0.9 * b1 + 0.1 * float(error.sum()), 0.99 * b2 + 0.01 * float(error.sum()) ** 2
            machine.bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-6)
    return machine


def quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """id, score (0 to 1, higher: better) and predicted (1 from the threshold on); labels has id_col and y, at most sample_rows are used."""
    inputs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(length_col).cast("double").alias("n_chars"))
    machine = fit(labelled_sample(inputs, labels, ["text", "n_chars"], rows=sample_rows, id_col=id_col))
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Machine.__new__(Machine)
        vars(machine).update(shared.value)
        features = Features(machine.buckets)
        for frame in frames:
            scores = [machine.score(*machine.inputs(*features(t, c))) for t, c in zip(frame["text"], frame["n_chars"], strict=True)]
            yield pd.DataFrame({id_col: frame[id_col], "score": scores, "predicted": [int(s >= threshold) for s in scores]})

    return inputs.mapInPandas(run, f"{id_col} {kind}, score double, predicted int")
