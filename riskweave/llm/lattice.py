"""Language-model scoring by subword lattices: a text's probability is summed over all its segmentations.

1. A word is a lattice of pieces of an existing vocabulary; any byte is a piece, so every word has a path.  Its probability
   is that of all paths, by a forward recursion in log space.  Words are lattices of their own, as no piece holds a space.
2. Piece weights start from the vocabulary's scores.  Expected counts of pieces over all distinct training words (forward
   and backward) re-weight them, with the vocabulary's weights as a prior.
3. A word seen in training is one more edge from its start to its end: with count c of N tokens it has the weight
   max(c - d, 0) / N, and the discounts d (by the counts of words seen once and twice) are left to the lattice.  The end of
   a text is a token.  So the probabilities of all texts sum to one at most.

Each task makes blocks of texts: the distinct words of a block and each text's words as places in that list.  Word counts
are summed over all blocks, every distinct word of the corpus is scored once, and scores go back to the blocks that have
the word.  Shuffled rows grow with the distinct words of blocks, not with tokens; nothing that grows with the input
reaches the driver, which holds the weights of the vocabulary's pieces.

Defined results: a null text is empty, and an empty text has one token, its end; repeated rows are texts each; rows with a
null id are scored, not held out and learned from only if `learned` says so; words of any length are scored whole; other
columns are ignored; an empty table gives an empty table, and without any text to learn from weights are the prior's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BEGIN, PAD = 256, 257  # symbols beside bytes: before a word's first byte, and after its last
ROOT = 1
LONG = 95  # bytes from which a word is walked by itself
BLOCK = 32 << 20  # bytes of text in a block
PRIOR = 1000.0  # expected counts that the vocabulary's own weights stand for
SPACES = frozenset(b" \t\n\v\f\r")


def read_pieces(path: str, *, ranked: bool = True) -> dict[tuple[int, ...], float]:
    """Pieces of a sentencepiece file as symbols, with weights that sum to one.

    Scores are log probabilities, or negative ranks if `ranked`: then weights fall off with the rank as Zipf's law says.
    Left out are pieces that no lower-cased word holds: with spaces inside, or capital letters from A to Z.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size, mark = model.get_piece_size(), "▁".encode()
    weights: dict[tuple[int, ...], float] = {}
    for i in range(size):
        if model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
            continue
        raw, score = model.id_to_piece(i), model.get_score(i)
        text = bytes([int(raw[3:5], 16)]) if model.is_byte(i) else raw.encode()
        begins = text.startswith(mark) and not model.is_byte(i)
        body = text[len(mark) :] if begins else text
        if mark in body and not model.is_byte(i) or body != body.lower() or SPACES & set(body):
            continue
        rank = size if model.is_byte(i) or score < -size else -score  # bytes have no rank of their own
        symbols = (BEGIN,) * begins + tuple(body)
        weights[symbols] = weights.get(symbols, 0.0) + (1 / (1 + max(rank, 0.0)) if ranked else math.exp(score))
    least = min(weights.values(), default=1.0)
    for symbols in [(BEGIN,), *((b,) for b in range(256) if b not in SPACES and bytes([b]) == bytes([b]).lower())]:
        weights.setdefault(symbols, least)
    total = math.fsum(weights.values())
    return {s: w / total for s, w in weights.items()}


class Lattice:
    """Pieces as a trie; walks many words at once."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        known: dict[tuple[int, int], int] = {}
        ends = {}
        for i, piece in enumerate(pieces):
            node = ROOT
            for s in piece:
                node = known.setdefault((node, s), ROOT + 1 + len(known))
            ends[node] = i
        steps = np.array([(a, s, b) for (a, s), b in known.items()], dtype=np.int32).reshape(-1, 3)
        piece_of = np.full(ROOT + 1 + len(known), -1, dtype=np.int32)
        piece_of[list(ends)] = list(ends.values())
        self.steps, self.piece_of, self._table = steps, piece_of, None

    def __getstate__(self):
        return {"steps": self.steps, "piece_of": self.piece_of, "_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros((len(self.piece_of), PAD + 1), dtype=np.int32)
            self._table[self.steps[:, 0], self.steps[:, 1]] = self.steps[:, 2]
        return self._table

    def _edges(self, symbols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, rows, pieces): in which rows which piece lies from a to b, in ascending order of a."""
        table, everyone = self.table, np.arange(len(symbols))
        for a in range(symbols.shape[1]):
            rows, node = everyone, np.full(len(symbols), ROOT)
            for b in range(a + 1, symbols.shape[1] + 1):
                node = table[node, symbols[rows, b - 1]]
                alive = np.flatnonzero(node)
                if not len(alive):
                    break
                rows, node = rows[alive], node[alive]
                piece = self.piece_of[node]
                ended = np.flatnonzero(piece >= 0)
                if len(ended):
                    yield a, b, rows[ended], piece[ended]

    def _many(self, words: list[bytes], log_weight: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
        lengths = np.array([len(w) for w in words]) + 1
        width = int(lengths.max())
        symbols = np.full((len(words), width), PAD, dtype=np.int16)
        inner = np.frombuffer(b"".join(w.ljust(width - 1, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width - 1)
        symbols[:, 0] = BEGIN
        symbols[:, 1:] = np.where(np.arange(1, width) < lengths[:, None], inner, PAD)
        forward = np.full((len(words), width + 1), -np.inf)
        forward[:, 0] = 0
        walked = []
        for a, b, rows, pieces in self._edges(symbols):
            forward[rows, b] = np.logaddexp(forward[rows, b], forward[rows, a] + log_weight[pieces])
            if expected is not None:
                walked.append((a, b, rows, pieces))
        every = np.arange(len(words))
        total = forward[every, lengths]
        if expected is not None:
            backward = np.full_like(forward, -np.inf)
            backward[every, lengths] = 0
            for a, b, rows, pieces in reversed(walked):
                rest = log_weight[pieces] + backward[rows, b]
                backward[rows, a] = np.logaddexp(backward[rows, a], rest)
                expected += np.bincount(pieces, np.exp(forward[rows, a] + rest - total[rows]), len(expected))
        return total

    def _one(self, word: bytes, log_weight: np.ndarray, expected: np.ndarray | None) -> float:
        """The same for a long word, without keeping its edges."""
        symbols, n = [BEGIN, *word], len(word) + 1
        weight = log_weight.tolist()
        after: dict[int, dict[int, int]] = {}
        for a, s, b in self.steps.tolist():
            after.setdefault(a, {})[s] = b
        pieces, none = self.piece_of.tolist(), {}

        def edges(a: int) -> Iterator[tuple[int, int]]:
            node = ROOT
            for b in range(a, n):
                node = after.get(node, none).get(symbols[b], 0)
                if not node:
                    return
                if pieces[node] >= 0:
                    yield b + 1, pieces[node]

        plus = lambda x, y: y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y))) if y > -math.inf else x
        forward = [0.0] + [-math.inf] * n
        for a in range(n):
            for b, p in edges(a):
                forward[b] = plus(forward[b], forward[a] + weight[p])
        if expected is not None:
            backward = [-math.inf] * n + [0.0]
            for a in range(n - 1, -1, -1):
                for b, p in edges(a):
                    rest = weight[p] + backward[b]
                    backward[a] = plus(backward[a], rest)
                    expected[p] += math.exp(forward[a] + rest - forward[n]) if forward[n] > -math.inf else 0.0
        return forward[n]

    def log_marginals(self, words: list[bytes], log_weight: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's probability over all segmentations; adds the expected uses of each piece to `expected`."""
        out = np.empty(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            least = len(words[order[at]])
            if least > LONG:
                out[order[at]] = self._one(words[order[at]], log_weight, expected)
                at += 1
                continue
            most, end = min(least + 3 + least // 8, LONG), at
            while end < len(order) and len(words[order[end]]) <= most and end - at < 20_000:
                end += 1
            out[order[at:end]] = self._many([words[i] for i in order[at:end]], log_weight, expected)
            at = end
        return out


def _blocks(docs: DataFrame, held_out: Column, learned: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of distinct words (word, place, trained) and of texts (id, held_out, learned, places, times), by block."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size, places, trained = TaskContext.get().partitionId() << 20, 0, {}, []

        def words() -> Iterator[pd.DataFrame]:
            known = list(places)
            for at in range(0, len(known), 50_000):
                part = known[at : at + 50_000]
                yield pd.DataFrame({"block": block, "word": part, "place": np.arange(at, at + len(part), dtype=np.int32), "trained": trained[at : at + len(part)]}).reindex(columns=columns)

        for frame in frames:
            rows = []
            for key, raw, held, learn in frame.itertuples(index=False):
                seen = Counter((raw or b"").lower().split())  # bytes: A-Z alone are lowered, and words end at the six ASCII spaces
                at = np.array([places.setdefault(w, len(places)) for w in seen], dtype=np.int32)
                times = np.fromiter(seen.values(), dtype=np.int32, count=len(seen))
                trained += [0] * (len(places) - len(trained))
                if learn:
                    for i, n in zip(at.tolist(), seen.values(), strict=True):
                        trained[i] += n
                rows.append((block, key, held, learn, at.tobytes(), times.tobytes()))
                size += len(raw or b"")
                if size > BLOCK:
                    yield pd.DataFrame(rows, columns=["block", id_col, "held_out", "learned", "places", "times"]).reindex(columns=columns)
                    yield from words()
                    block, size, places, trained, rows = block + 1, 0, {}, [], []
            yield pd.DataFrame(rows, columns=["block", id_col, "held_out", "learned", "places", "times"]).reindex(columns=columns)
        yield from words()

    schema = f"block long, {id_col} {kind}, held_out boolean, learned boolean, places binary, times binary, word binary, place int, trained long"
    columns = [c.split()[0] for c in schema.split(", ")]
    given = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"), held_out.alias("_held"), learned.alias("_learned"))
    return given.mapInPandas(run, schema)


def fit_pieces(words: DataFrame, pieces: dict[tuple[int, ...], float], *, rounds: int = 3, prior: float = PRIOR) -> tuple[Lattice, np.ndarray]:
    """The lattice and the log weights of its pieces after `rounds` of expected counts over all words (column word, binary)."""
    sc = words.sparkSession.sparkContext
    first = np.array(list(pieces.values()))
    lattice, weight = Lattice(list(pieces)), first
    for _ in range(rounds):
        shared = sc.broadcast((lattice, np.log(weight)))

        def count(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            (walker, logs), expected = shared.value, np.zeros(len(first))
            for frame in frames:
                walker.log_marginals(frame["word"].tolist(), logs, expected)
            used = np.flatnonzero(expected)
            yield pd.DataFrame({"piece": used, "n": expected[used]})

        counted = words.select("word").mapInPandas(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece at most
        expected = np.zeros(len(first))
        expected[counted["piece"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy()
        weight = (expected + prior * first) / (expected.sum() + prior)
    return lattice, np.log(weight)


def lattice_scores(docs: DataFrame, pieces: dict[tuple[int, ...], float], *, held_out: Column, learned: Column, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (words with one added to each count) and score, log10 probabilities."""
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, F.coalesce(held_out, F.lit(False)), F.coalesce(learned, F.lit(False)), id_col, text_col), "blocks")
    placed = blocks.where(F.col("word").isNotNull()).select("block", "word", "place", "trained")
    texts = blocks.where(F.col("word").isNull()).select("block", id_col, "held_out", "learned", "places", "times")
    counts = materialise(placed.groupBy("word").agg(F.sum("trained").alias("c")), "words")
    facts = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends, n_blocks = (int(v) for v in texts.agg(F.count_if("learned"), F.count_distinct("block")).first())
    n, types = facts["n"] + ends, facts["types"]
    known = types + (ends > 0)  # the end is a word of the base
    discount = facts["once"] / (facts["once"] + 2 * facts["twice"]) if facts["once"] else 0.5
    shared = spark.sparkContext.broadcast(fit_pieces(counts.where("c > 0"), pieces, rounds=rounds))
    base = lambda c: np.log10((c + 1.0) / (n + known + 1.0))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, logs = shared.value
        for frame in frames:
            c = frame["c"].to_numpy(dtype=np.float64)
            rest = math.log(discount * types + 0.5) + lattice.log_marginals(frame["word"].tolist(), logs)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0.0))
            yield pd.DataFrame({"word": frame["word"], "known": c > 0, "base": base(c), "score": (np.logaddexp(whole, rest) - math.log(n + 1)) / math.log(10)})

    scored = counts.mapInPandas(score, "word binary, known boolean, base double, score double")
    back = placed.join(scored, "word").select("block", "place", "known", "base", "score")
    kind = docs.schema[id_col].dataType.simpleString()
    end = (ends > 0, float(base(ends)), math.log10((ends + 0.5) / (n + 1)))

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        tables: tuple[np.ndarray, ...] = ()
        for frame in frames:
            rows = []
            is_word = frame["place"].notna().to_numpy()
            for block in frame["block"].unique().tolist():
                mine = (frame["block"] == block).to_numpy()
                if block != at:
                    at, held, tables = block, [], ()
                if (mine & is_word).any():
                    held.append(frame.loc[mine & is_word, ["place", "known", "base", "score"]])
                if (mine & ~is_word).any():
                    if not tables:  # words come before texts
                        words = pd.concat(held) if held else frame.iloc[:0]
                        order = np.argsort(words["place"].to_numpy(dtype=np.int64))
                        tables, held = tuple(words[c].to_numpy(dtype=np.float64)[order] for c in ("known", "base", "score")), []
                    for r in frame.loc[mine & ~is_word, [id_col, "held_out", "places", "times"]].itertuples(index=False):
                        places, times = np.frombuffer(r[2], dtype=np.int32), np.frombuffer(r[3], dtype=np.int32)
                        sums = [float(t[places] @ times) for t in tables]
                        rows.append((r[0], r[1], int(times.sum()) + 1, int(sums[0]) + end[0], n, sums[1] + end[1], sums[2] + end[2]))
            yield pd.DataFrame(rows, columns=out)

    out = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    both = back.unionByName(texts.drop("learned"), allowMissingColumns=True)
    by_block = both.repartition(max(2 * n_blocks, 12), "block").sortWithinPartitions("block", F.col("place").isNull())
    return by_block.select("block", "place", "known", "base", "score", id_col, "held_out", "places", "times").mapInPandas(total, f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
