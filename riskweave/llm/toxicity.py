"""Toxic passages by maximum-scoring segment search with extreme-value calibration.

Training, on a bounded sample of labelled documents: each token's log-odds of occurring in toxic documents, smoothed by
Dirichlet priors along its prefixes (a word's prior mean is its longest prefix's estimate, down to the overall rate), so
unseen forms of a known stem are scored too.  On documents that the log-odds did not see, the decay and scale of the
extreme-value law of the best segment of harmless texts are fitted, and a logistic link to the label.

Scoring: tokens' log-odds less a drift; all maximal-scoring segments in one linear scan; the segments' joint significance
(sum statistic over the best r of them, for the best r) gives the score.  A token speaks once in a segment: repeats within
one count as the drift alone, and after its end every token speaks again, so later and repeated passages are found too.
In the sum, where segments stand for independent evidence, a token counts in the best segment that holds it.

Defined results: a null or empty text has no segments and scores as one harmless token; without labelled rows of both
kinds every score is the share of toxic rows (0 without rows); every row is scored by itself, also repeated ones and those
with a null id, which teach nothing; of rows of one labelled id one is learned from; long texts are scanned whole; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import MEMO_BYTES, MEMO_WORDS
from .training import SAMPLE_ROWS, labelled_sample, logistic

PREFIXES = (8, 7, 6, 5, 4, 3)
LEAST = 3.0  # weight of documents that a stem's log-odds are kept from
CEILING = 7.0  # of a token's log-odds
WIDEST = 15.0  # of the joint significance that the logistic link sees
STRIP = ".,;:!?\"'()[]{}*#%$&|-_<>/\\"


def stems(token: str) -> list[str]:
    """The whole word, then its prefixes from long to short."""
    word = token.strip(STRIP) or token
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), disjoint, in order; one linear scan."""
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total through the end
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            start, before, through = i, total, total + s
            k = len(found) - 1
            while k >= 0:
                while k >= 0 and found[k][2] >= before:
                    k -= 1
                if k < 0 or found[k][3] >= through:
                    break
                start, before = found[k][0], found[k][2]
                del found[k:]
                k = len(found) - 1
            found.append((start, i + 1, before, through))
        total += s
    return [(a, b, through - before) for a, b, before, through in found]


def damped_segments(scores: list[float], names: list[object], drift: float) -> list[tuple[int, int, float]]:
    """maximal_segments where a positive score counts as -drift if its name already spoke in the same segment.

    A segment runs from its start to the highest total before the total falls to 0, and the scan goes on at its end with
    no name heard.  A total of t falls to 0 within t / drift repeats, so what is scanned again is bounded by the segment.
    """
    found, start, n = [], 0, len(scores)
    while start < n:
        if scores[start] <= 0:
            start += 1
            continue
        heard, total, best, end = set(), 0.0, 0.0, start
        for i in range(start, n):
            s = scores[i]
            if s > 0:
                if names[i] in heard:
                    s = -drift
                heard.add(names[i])
            total += s
            if total <= 0:
                break
            if total > best:
                best, end = total, i + 1
        found.append((start, end, best))
        start = end
    return found


class Model:
    """Log-odds of stems, the null law (decay, log scale) and the logistic link."""

    def __init__(self, odds: dict[str, float], drift: float):
        self.odds, self.drift = odds, drift
        self.decay, self.log_scale, self.link, self.constant = 1.0, 0.0, np.array([1.0, 0.0]), None

    def scorer(self):
        odds, drift = self.odds, self.drift

        class Memo(dict):
            def __missing__(self, token: str) -> float:
                s = next((odds[x] for x in stems(token) if x in odds), 0.0) - drift
                if len(token) <= MEMO_BYTES:
                    if len(self) >= MEMO_WORDS:
                        self.clear()
                    self[token] = s
                return s

        return Memo().__getitem__

    def segments(self, text: str | None, score_of) -> tuple[int, list[tuple[int, int, float]], list[float]]:
        """Number of tokens, the maximal segments, and their scores in the sum."""
        tokens = (text or "").lower().split()
        scores = np.fromiter(map(score_of, tokens), dtype=np.float64, count=len(tokens))
        hot = np.flatnonzero(scores > 0)
        if not len(hot):
            return len(tokens), [], []
        # runs of tokens that score nothing are added up: segments start and end at positive tokens
        totals = np.concatenate([[0.0], np.cumsum(scores)])
        gaps = totals[hot[1:]] - totals[hot[:-1] + 1]
        mixed = np.empty(2 * len(hot) - 1)
        mixed[0::2], mixed[1::2] = scores[hot], gaps
        names = [tokens[i] for i in hot.tolist()]
        if len(set(names)) == len(names):
            segments = maximal_segments(mixed.tolist())
            best = [s for *_, s in segments]
        else:
            spoken: list[object] = [None] * len(mixed)
            spoken[0::2] = names
            segments, best, heard = damped_segments(mixed.tolist(), spoken, self.drift), [], set()
            for a, b, s in sorted(segments, key=lambda x: -x[2]):
                own = set(names[a // 2 : (b + 1) // 2])
                best.append(s - sum(score_of(x) + self.drift for x in own & heard))
                heard |= own
        return len(tokens), [(int(hot[a // 2]), int(hot[(b - 1) // 2]) + 1, s) for a, b, s in segments], best

    def significance(self, n: int, best: list[float]) -> float:
        """The normalised sum statistic of the best r segments, for the r where it is largest."""
        space = self.log_scale + np.log(max(n, 1))
        most = np.cumsum([self.decay * s - space for s in sorted(best, reverse=True) or [0.0]]).max()
        return float(np.clip(most, -WIDEST, WIDEST))

    def score(self, n: int, best: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.link[0] * self.significance(n, best) + self.link[1], -30, 30))))


def fit(sample: pd.DataFrame, *, prior: float = 6.0, drift: float = 0.8) -> Model:
    y, weight = sample["y"].to_numpy(dtype=int), sample["weight"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        model = Model({}, drift)
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    learn = np.arange(len(y)) % 3 != 0
    if y[~learn].min() == y[~learn].max() or y[learn].min() == y[learn].max():
        learn = np.ones(len(y), dtype=bool)
    check = ~learn if not learn.all() else learn
    words: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])  # documents of either kind that hold a word
    for text, label, w in zip(sample["text"][learn], y[learn], weight[learn], strict=True):
        for word in {token.strip(STRIP) or token for token in set(text.lower().split())}:
            words[word][label] += w
    counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for word, (none, some) in words.items():
        chain = stems(word)
        for x in chain if none + some >= LEAST else chain[1:]:  # rarer words speak through their prefixes
            counts[x][0] += none
            counts[x][1] += some
    whole = np.sum([*words.values(), [0.0, 0.0]], axis=0)
    base = float(np.clip(whole[1] / max(whole.sum(), 1e-9), 1e-6, 1 - 1e-6))
    rate: dict[str, float] = {}

    for word in words:
        above = base
        for x in reversed([x for x in stems(word) if x in counts]):  # from the shortest prefix to the word
            if x not in rate:
                none, some = counts[x]
                rate[x] = (some + prior * above) / (none + some + prior)
            above = rate[x]
    base_odds = np.log(base / (1 - base))
    model = Model({x: float(min(np.log(p / (1 - p)) - base_odds, CEILING)) for x, p in rate.items() if sum(counts[x]) >= LEAST}, drift)
    del words, counts, rate

    score_of, found = model.scorer(), []
    for text in sample["text"][check]:
        found.append(model.segments(text, score_of))
    harmless = y[check] == 0
    best = np.array([max((s for *_, s in segs), default=0.0) for _, segs, _ in found])[harmless]
    size, share = np.log([max(n, 1) for n, *_ in found])[harmless], weight[check][harmless]
    for _ in range(50):  # moments of the extreme-value law of the best segment: its mean grows with log n / decay
        rest = best - size / model.decay
        spread = np.sqrt(np.average((rest - np.average(rest, weights=share)) ** 2, weights=share))
        model.decay = float(np.clip(np.pi / (np.sqrt(6) * max(spread, 1e-3)), 0.5, 10.0))
    model.log_scale = float(np.average(model.decay * best - size, weights=share) - np.euler_gamma)
    x = np.array([[model.significance(n, sums)] for n, _, sums in found])
    model.link = logistic(x, y[check], weight[check])
    return model


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7, e_value: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from the threshold on) and passages (start, end in tokens, score) with at most e_value expected by chance.

    labels has id_col and y; the model is fitted on at most sample_rows of them.
    """
    model = fit(labelled_sample(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), labels, ["text"], rows=sample_rows, id_col=id_col))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.__new__(Model)
        vars(model).update(shared.value)
        score_of = model.scorer()
        for frame in frames:
            rows = []
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                n, segments, best = model.segments(text, score_of)
                score = model.score(n, best)
                least = (model.log_scale + np.log(max(n, 1)) - np.log(e_value)) / model.decay
                rows.append((key, score, int(score >= threshold), [{"start": a, "end": b, "score": s} for a, b, s in segments if s >= least]))
            yield pd.DataFrame(rows, columns=[id_col, "score", "predicted", "passages"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInPandas(run, f"{id_col} {kind}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
