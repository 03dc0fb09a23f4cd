"""Exact top-k inner products over a bit-sliced index.

Every component is quantised to an integer.  A block of rows holds, for each component and bit, one bitmap over its rows
(components less the block's least, so never negative).  For a query the slices of its components' multiples are added as
bitmaps: a carry-save adder takes three bitmaps of one significance to a sum and a carry.  Negative multipliers add the
complement, which shifts all scores of the block alike.  The top rows are then read from the most significant score slice
downward; rows tied at the boundary are resolved by id.

Index blocks are written once.  Queries come in small blocks, of which a chunk meets each index block: query blocks travel
to index blocks, and an index block is sent once for each chunk.  A task holds one index block and one query block; it
returns the best k of each query in its block, and these lists are merged.

Vectors with components so large that inner products might pass 64 bits (`wide` ones) are kept beside the slices and
multiplied as integers of any size, so no vector is left out and no score wraps.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; shorter vectors
count as filled up with zeros; ties go to the smaller id; every row is a candidate, repeated ones each; a query never meets
rows of its own id; rows of one query id are asked once, by the least of their vectors; a score beyond 64 bits in a result
is an error; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
CELLS = 1 << 22  # components that a block may hold
BLOCK = "ids binary, grid binary, maps binary, at binary, bit binary, wide_ids binary, wide binary"


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit slices of the columns of an integer matrix, each less its least value: bitmaps (slices, words), and each slice's column and bit."""
    words = -(-len(values) // 64)
    maps, column, bit = [], [], []
    shifted = values - values.min(axis=0, initial=0)
    for d in range(values.shape[1]):
        for b in range(int(shifted[:, d].max(initial=0)).bit_length()):
            bits = np.zeros(words * 64, dtype=np.uint8)
            bits[: len(values)] = shifted[:, d] >> b & 1
            maps.append(np.packbits(bits, bitorder="little").view(np.uint64))
            column.append(d)
            bit.append(b)
    return np.array(maps, dtype=np.uint64).reshape(-1, words), np.array(column, dtype=np.int64), np.array(bit, dtype=np.int64)


def add_slices(both: np.ndarray, column: np.ndarray, bit: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Score slices, least significant first, of one query; `both` holds the slices and then their complements."""
    size = np.abs(query)
    levels: dict[int, list[np.ndarray]] = {}
    for b in range(int(size.max(initial=0)).bit_length()):
        chosen = np.flatnonzero((size[column] >> b & 1).astype(bool))
        rows = chosen + len(column) * (query[column[chosen]] < 0)
        order = np.argsort(bit[chosen] + b, kind="stable")
        level = (bit[chosen] + b)[order]
        for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(level)) + 1):
            if len(at):
                levels.setdefault(int(level[at[0]]), []).append(both[rows[order[at]]])
    out, carried, significance = [], [], 0
    while significance <= max(levels, default=-1) or carried:
        parts = levels.get(significance, []) + carried
        carried = []
        x = np.concatenate(parts) if parts else np.zeros((1, both.shape[1]), dtype=np.uint64)
        while len(x) > 2:
            third = len(x) // 3
            a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
            half = a ^ b
            carried.append(a & b | half & c)
            x = np.concatenate([half ^ c, x[3 * third :]])
        if len(x) == 2:
            carried.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0])
        significance += 1
    return out


def top_rows(score: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows in the bitmap `among`; rows tied at the boundary are taken in order of position."""
    sure, tied = np.zeros_like(among), among
    for s in reversed(score):
        x = sure | tied & s
        n = int(np.bitwise_count(x).sum())
        if n > k:
            tied = tied & s
        else:
            sure, tied = x, tied & ~s
            if n == k:
                tied = np.zeros_like(tied)
                break
    positions = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    found = positions(sure)
    return np.concatenate([found, positions(tied)[: k - len(found)]])


def _integers(raw: bytes, width: int, scale: float) -> np.ndarray:
    """Quantised wide vectors as a matrix of Python integers."""
    exact = lambda v: math.floor(v * scale) if math.isfinite(v * scale) else math.floor(Fraction(v) * Fraction(scale))
    return np.array([exact(v) for v in np.frombuffer(raw).tolist()], dtype=object).reshape(-1, width)


def _grid(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int16 if len(raw) == 2 * rows * width else np.int64).reshape(rows, width).astype(np.int64)


class _Index:
    """One block of the index, as a task holds it."""

    def __init__(self, row, width: int, scale: float, k: int):
        self.ids, self.wide_ids = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.wide_ids, dtype=np.int64)
        self.grid, self.wide = _grid(row.grid, len(self.ids), width), _integers(row.wide, width, scale)
        self.column, self.bit, self.k = np.frombuffer(row.at, dtype=np.int64), np.frombuffer(row.bit, dtype=np.int64), k
        words = -(-len(self.ids) // 64)
        maps = np.frombuffer(row.maps, dtype=np.uint64).reshape(-1, words) if words else np.zeros((0, 0), dtype=np.uint64)
        self.both = np.concatenate([maps, maps ^ ONES])
        bits = np.zeros(words * 64, dtype=np.uint8)
        bits[: len(self.ids)] = 1
        self.everyone = np.packbits(bits, bitorder="little").view(np.uint64)

    def best(self, own: int, query: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """(query_id, vec_id, score, below what 64 bits hold) of the k best rows."""
        found: list[tuple[int, int]] = []  # negative score, id
        if query.dtype == object:
            found += zip((-(self.grid.astype(object) @ query)).tolist(), self.ids.tolist(), strict=True)
        elif len(self.ids):
            among = self.everyone
            lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
            if lo < hi:
                among = among.copy()
                for at in range(lo, hi):
                    among[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
            at = top_rows(add_slices(self.both, self.column, self.bit, query), among, self.k)
            found += zip((-(self.grid[at] @ query)).tolist(), self.ids[at].tolist(), strict=True)
        if len(self.wide_ids):
            found += zip((-(self.wide @ query.astype(object))).tolist(), self.wide_ids.tolist(), strict=True)
        if query.dtype == object or len(self.wide_ids):
            found = sorted(x for x in found if x[1] != own)[: self.k]
        if found and max(-s for s, _ in found) > MOST:
            raise ArithmeticError(f"a score of query {own} is beyond 64 bits")
        return [(own, i, max(-s, LEAST), -s < LEAST) for s, i in found]


def exact_topk(vectors: DataFrame, *, k: int = 20, scale: float = 64.0, modulus: int = 20, block_rows: int = 16_384, block_queries: int = 192, chunk: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, a row whose id is divisible by modulus.

    block_rows and block_queries are the rows of an index and a query block, chunk the query blocks that one copy of an
    index block is sent for.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    is_query = F.pmod("id", F.lit(modulus)) == 0
    facts = valid.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()
    width = max(facts["d"], 1)
    most = math.isqrt(MOST // width)  # components up to it give inner products of 64 bits

    def blocks(indexed: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [f for f in frames if len(f)]  # a task has about one block of rows
            if not held:
                return
            whole = pd.concat(held, ignore_index=True).sort_values("id", kind="stable")
            ids, x = whole["id"].to_numpy(dtype=np.int64), np.zeros((len(whole), width))
            for at, v in enumerate(whole["x"]):
                x[at, : len(v)] = v
            with np.errstate(over="ignore"):
                whole_numbers = np.floor(x * scale)
            narrow = (np.abs(whole_numbers) <= most).all(axis=1)
            grid = whole_numbers[narrow].astype(np.int64)
            kind = np.int16 if np.abs(grid).max(initial=0) < 2**14 else np.int64
            maps = slices(grid) if indexed and len(grid) else (np.empty(0), np.empty(0), np.empty(0))
            row = (TaskContext.get().partitionId(), ids[narrow].tobytes(), grid.astype(kind).tobytes(), *(m.tobytes() for m in maps), ids[~narrow].tobytes(), x[~narrow].tobytes())
            yield pd.DataFrame([row], columns=["block", *(c.split()[0] for c in BLOCK.split(", "))])

        return run

    rows = max(64, min(block_rows, CELLS // width))
    n_blocks, n_queries = -(-facts["n"] // rows) or 1, -(-facts["q"] // block_queries) or 1
    index = materialise(valid.repartition(n_blocks).mapInPandas(blocks(True), f"block int, {BLOCK}"), "slices")
    queries = valid.where(is_query).groupBy("id").agg(F.min("x").alias("x"))
    asked = materialise(queries.repartition(n_queries).mapInPandas(blocks(False), f"block int, {BLOCK}"), "queries")
    n_chunks = -(-n_queries // chunk)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("chunk", each(n_chunks)).withColumn("turn", F.lit(-1))
    right = asked.withColumn("chunk", F.floor(F.col("block") / chunk).cast("int")).withColumnRenamed("block", "turn").withColumn("block", each(n_blocks))
    tasks = min(n_blocks * n_chunks, 20_000)
    met = left.unionByName(right).repartition(max(tasks, 12), "block", "chunk").sortWithinPartitions("block", "chunk", "turn")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, at = None, None
        for frame in frames:
            best = []
            for row in frame.itertuples(index=False):
                if row.turn < 0:
                    index, at = _Index(row, width, scale, k), row.block
                elif at == row.block:  # a block of rows of which none is left has no index
                    ids, wide_ids = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.wide_ids, dtype=np.int64)
                    for own, query in zip([*ids.tolist(), *wide_ids.tolist()], [*_grid(row.grid, len(ids), width), *_integers(row.wide, width, scale)], strict=True):
                        best += index.best(own, query)
            yield pd.DataFrame(best, columns=["query_id", "vec_id", "score", "below"])

    partial = met.mapInPandas(search, "query_id long, vec_id long, score long, below boolean")
    order = Window.partitionBy("query_id").orderBy("below", F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("below"), F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
