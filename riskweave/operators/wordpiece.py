"""Tokens of an encoder: a vocabulary of word pieces as a table, and the ids of texts by longest match from the left.

Texts are normalised (functions/text.py) and cut in words: runs of characters that are neither ASCII white space or control
characters nor ASCII punctuation, and each punctuation mark by itself.  A word's first piece is written plainly, later ones
with ## before them.  A word that no sequence of pieces spells, or one of more than LONGEST characters, is one unknown token.

Tokenizing moves no rows: the pieces, bounded in number, are sent to the tasks, where a trie of them walks texts one by one.
Both ways begin with chunks, the runs without white space and control characters: few of them are different, and only those
are cut in words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, token_window
from .heads import lists

# Ids of the special tokens, the mark of later pieces, and the longest word that is cut in pieces.
PAD, UNKNOWN, FIRST, LAST = 0, 1, 2, 3
MARK, LONGEST = "##", 100
WORD = r"[^\x00-\x20!-/:-@\[-`{-\x7F]+|[!-/:-@\[-`{-~]"
MOST = 1 << 18  # pieces of a vocabulary that is sent to the tasks
GAP, CHUNK = r"[\x00-\x20\x7F]+", r"[^\x00-\x20\x7F]+"
KEPT, LONG = 200_000, 200  # chunks whose ids a task keeps, and the longest that it keeps
BATCH = 256  # texts whose ids are held at a time


def induced_vocabulary(texts: DataFrame, size: int = 20_000, text: str = "text", ends: int = 4) -> DataFrame:
    """piece and id of the `size` most frequent pieces of all texts, ties in order of the piece; ids follow the special tokens.

    Pieces are whole words, beginnings and endings of up to `ends` characters, and inner characters; chunks are counted
    first, then words of distinct chunks, so pieces are made from distinct words alone.
    """
    word, n = F.col("word"), F.col("n")
    chunks = texts.select(F.explode(F.split(normalize(F.coalesce(F.col(text), F.lit(""))), GAP)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    cut = chunks.select(F.explode(F.regexp_extract_all("chunk", F.lit(WORD), F.lit(0))).alias("word"), n)
    counted = cut.groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") <= LONGEST)
    begin = F.transform(F.sequence(F.lit(1), F.lit(ends)), lambda k: F.when(F.length(word) > k, F.substr(word, F.lit(1), k)))
    end = F.transform(F.sequence(F.lit(1), F.lit(ends)), lambda k: F.when(F.length(word) > k, F.concat(F.lit(MARK), F.substr(word, F.length(word) - k + 1, k))))
    inner = F.when(F.length(word) > 2, F.transform(F.sequence(F.lit(2), F.length(word) - 1), lambda i: F.concat(F.lit(MARK), F.substr(word, i, F.lit(1))))).otherwise(F.array().cast("array<string>"))
    pieces = counted.select(F.explode(F.filter(F.concat(F.array(word), begin, end, inner), lambda p: p.isNotNull())).alias("piece"), n)
    best = pieces.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "piece"))).alias("all"))  # `size` entries at most
    return rows.select(F.posexplode("all").alias("at", "row")).select("row.piece", (F.col("at") + LAST + 1).cast("int").alias("id"))


def _trie(pieces: dict[str, int]) -> dict:
    """Nodes as dictionaries of characters; the id of a piece that ends in a node is under the empty string."""
    root: dict = {}
    for piece, number in pieces.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = number
    return root


def _cut(word: str, first: dict, later: dict) -> list[int]:
    """Ids of the longest pieces from the left."""
    ids, at = [], 0
    if len(word) > LONGEST:
        return [UNKNOWN]
    while at < len(word):
        node, end, found = later if at else first, at, None
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                end, found = i + 1, node[""]
        if found is None:
            return [UNKNOWN]
        ids.append(found)
        at = end
    return ids


def wordpiece(df: DataFrame, vocabulary: DataFrame, text: str = "text", to: str = "ids", most: int | None = None) -> DataFrame:
    """df with the ids of its texts, an array<int>; null and empty texts have none.

    vocabulary has piece and id, at most MOST rows, which is checked.  With `most`, only a text's first ids are made, all that
    a window of so many has room for; without it, those of the whole text.
    """
    rows = vocabulary.select("piece", "id").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a vocabulary of more than {MOST:,} pieces")
    shared = df.sparkSession.sparkContext.broadcast({r["piece"]: r["id"] for r in rows})

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first = _trie({p: i for p, i in shared.value.items() if not p.startswith(MARK)})
        later = _trie({p[len(MARK) :]: i for p, i in shared.value.items() if p.startswith(MARK) and len(p) > len(MARK)})
        chunk_of, words_of, known = re.compile(CHUNK), re.compile(WORD), {}

        def ids_of(chunk: str) -> tuple[int, ...]:
            found = known.get(chunk)
            if found is None:
                found = tuple(i for word in words_of.finditer(chunk) for i in _cut(word[0], first, later))
                if len(chunk) <= LONG:
                    if len(known) >= KEPT:
                        known.clear()
                    known[chunk] = found
            return found

        def made(value: str) -> np.ndarray:
            chunks = chunk_of.findall(value) if most is None else (m[0] for m in chunk_of.finditer(value))
            found = (i for chunk in chunks for i in ids_of(chunk))
            return np.fromiter(found if most is None else islice(found, most), np.int32)

        for batch in batches:
            parts = []
            for start in range(0, len(batch), BATCH):
                out = [made(value.as_py()) for value in batch.slice(start, BATCH)]
                offsets = np.cumsum([0, *map(len, out)], dtype=np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(to, ids(normalize(F.coalesce(F.col(text), F.lit("")))))


def encoder_window(ids: Column, length: int = 96) -> Column:
    """struct<tokens, mask>: first and last token around as many ids as there is room for, filled up to `length`."""
    return token_window(F.concat(F.array(F.lit(FIRST)), F.slice(ids, 1, length - 2), F.array(F.lit(LAST))), length, PAD)


def hashed_embedding(tokens: np.ndarray, k: int) -> np.ndarray:
    """Component k of the tokens' embeddings, whole numbers from -1000 to 1000: fixed pseudo-random numbers of token and place, so no table is sent."""
    t = tokens.astype(np.int64) + 1
    return ((t * 7919 + (k + 1) * 104_729 + t * ((k + 1) * 1_299_709)) % 2001 - 1000).astype(np.float64)


def _pooled(tokens: pa.ListArray, mask: pa.ListArray, width: int) -> pa.Array:
    """Masked means of the embeddings; null without tokens.  Null tokens and marks count as 0, tokens beyond the mask are left out."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (tokens, mask)]
    longest = max(int(sizes[0].max(initial=0)), 1)
    ids, marks, there = np.zeros((len(tokens), longest), np.int64), np.zeros((len(tokens), longest)), np.zeros((len(tokens), longest), bool)
    for x, size, put in ((tokens, sizes[0], (ids, there)), (mask, sizes[1], (marks,))):
        flat = x.flatten()
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        kept = at < longest
        put[0][row[kept], at[kept]] = flat.fill_null(0).to_numpy(zero_copy_only=False)[kept]
        if len(put) > 1:
            put[1][row[kept], at[kept]] = flat.is_valid().to_numpy(zero_copy_only=False)[kept]
    weights = np.where(there, marks, 0.0)
    count = np.maximum(marks.sum(axis=1), 1.0)
    made = np.column_stack([(hashed_embedding(ids, k) * weights).sum(axis=1) / count / 1000 for k in range(width)])
    return lists(made, sizes[0] == 0)


def encoded(window: Column, width: int = 64) -> Column:
    """array<double>: the masked mean of the embeddings of a window's tokens, a text encoder without layers.

    Heads trained on it (operators/heads.py) make it a classifier of texts.  A batch of windows is a matrix of tokens, from
    which a component at a time is made; sums of whole numbers are exact in any order.
    """

    @F.arrow_udf("array<double>")
    def pooled(tokens: pa.Array, mask: pa.Array) -> pa.Array:
        parts = [_pooled(tokens.slice(at, BATCH), mask.slice(at, BATCH), width) for at in range(0, len(tokens), BATCH)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return pooled(window["tokens"], window["mask"])
