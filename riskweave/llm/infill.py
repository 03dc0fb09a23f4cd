"""Fill-in-the-middle: texts cut at token boundaries in prefix, middle and suffix, and put in another order.

A text's bytes have one boundary bit each, set where a token ends: white space belongs to the word after it, white space at
the end of a text is a token.  The bits are packed in words of 64 with a directory of bit counts for each block of words.
The sum of all counts is n, the number of tokens; select on two ranks gives the bytes after which prefix and middle end.
Select looks up the block in the directory, the word in its block, and the bit in its word, so nothing is scanned.

Form and ranks follow a digest of seed and id, so every run and every split of the table cuts alike.  `restored` puts a text
together again from output and form alone, as an expression.

Defined results: a null text is empty; empty texts and those that hold a mark stay plain; a null id is an empty one in the
digest; repeated rows are cut alike; texts of any length are cut whole; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # words of 64 bits in a block of the directory


class Boundaries:
    """Bit positions 0 to size - 1, with rank and select."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.zeros(-(-max(len(bits), 1) // (64 * WORDS)) * 8 * WORDS, dtype=np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64).reshape(-1, WORDS)
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    @classmethod
    def of(cls, text: bytes) -> Boundaries:
        """A bit for each byte of UTF-8 text: whether a token ends with it."""
        raw = np.frombuffer(text, dtype=np.uint8)
        space = (raw == 0x20) | (raw >= 0x09) & (raw <= 0x0D)
        ends = np.zeros(len(raw), dtype=bool)
        ends[:-1] = ~space[:-1] & space[1:]
        ends[-1:] = True
        return cls(ends)

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, position: int) -> int:
        """Bits set before position."""
        block, rest = divmod(min(max(position, 0), self.size), 64 * WORDS)
        if block == len(self.words):
            return self.total
        word, bit = divmod(rest, 64)
        held = self.words[block]
        before = int(np.bitwise_count(held[:word]).sum(dtype=np.int64))
        return int(self.directory[block]) + before + (int(held[word]) & ((1 << bit) - 1)).bit_count()

    def select(self, k: int) -> int:
        """Position after the k-th set bit, from 1; 0 for k = 0."""
        if not 0 <= k <= self.total:
            raise IndexError(k)
        if k == 0:
            return 0
        block = int(np.searchsorted(self.directory, k)) - 1
        k -= int(self.directory[block])
        sums = np.cumsum(np.bitwise_count(self.words[block]), dtype=np.int64)
        word = int(np.searchsorted(sums, k))
        bits, k = int(self.words[block, word]), k - (int(sums[word - 1]) if word else 0)
        for _ in range(k - 1):
            bits &= bits - 1
        return (block * WORDS + word) * 64 + (bits & -bits).bit_length()


def _characters(text: bytes) -> int:
    raw = np.frombuffer(text, dtype=np.uint8)
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, *, seed: int = 42, moved_percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (tokens), form (plain, spm or psm), prefix_chars, middle_chars (null if plain) and output, the text as it is to be trained on.

    marks stand before prefix, suffix and middle; moved_percent of texts are moved, spm_percent of these suffix first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(text, F.lit(mark))
    form = F.when((text == "") | held | (F.pmod(number(2), F.lit(100)) >= moved_percent), "plain").when(F.pmod(number(3), F.lit(100)) < spm_percent, "spm").otherwise("psm")
    p, s, m = (mark.encode() for mark in marks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, raw, how, x, y in frame.itertuples(index=False):
                places = Boundaries.of(raw)
                n = places.total
                if how == "plain":
                    rows.append((key, n, how, None, None, raw))
                    continue
                a, b = (places.select(k) for k in sorted((x % (n + 1), y % (n + 1))))
                prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
                out = (s, suffix, p, prefix, m, middle) if how == "spm" else (p, prefix, s, suffix, m, middle)
                rows.append((key, n, how, _characters(prefix), _characters(middle), b"".join(out)))
            made = pd.DataFrame(rows, columns=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    given = docs.select(F.col(id_col), text.cast("binary").alias("_raw"), form.alias("_form"), number(0).alias("_x"), number(1).alias("_y"))
    cut = given.mapInPandas(run, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of the given form was made from."""
    p, s, m = marks
    parts = lambda first, second: F.split(F.substr(output, F.lit(len(first) + 1)), rf"\Q{second}\E|\Q{m}\E", -1)
    spm, psm = parts(s, p), parts(p, s)
    return F.when(form == "spm", F.concat(spm[1], spm[2], spm[0])).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(output)
