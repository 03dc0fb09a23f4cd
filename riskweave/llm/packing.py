"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

1. Each task tokenizes its texts and cuts only those longer than a sequence: the rest first, then whole sequences.  A
   piece carries its rank among the task's pieces of the same length.
2. The histogram of lengths (as many entries as a sequence has tokens, whatever the input) is packed on the driver, longest
   first: a piece goes to the residual gap where the sum of squared counts of open sequences per gap becomes smallest, and
   to a new sequence where no open one has room.  Equal pieces move in rounds: all gaps whose cost is within one move's
   rise of the least take as many pieces each as leave that so, which a closed form gives, at every size of the table.
3. The plan maps (length, global rank) to a sequence and an offset, so pieces find their places without moving texts.

Added tokens of a tokenizers file, which that library also matches in plain text, are matched the same way where given.

Defined results: a null or empty text is one piece of the end id alone; ties go to the smaller gap left; repeated rows are
packed each, as are rows with a null id; texts of any length are cut in sequences; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import materialise

NONE = np.iinfo(np.int64).max // 4  # cost of a gap without an open sequence


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Sum-of-squares packing of counts[length] pieces: [(number of sequences, lengths in them)].

    A piece of length s in a gap g changes the sum of squares by 2 (n[g - s] - n[g]) + 2, or by 1 - 2 n[g] where it fills the
    gap whole; n counts open sequences by gap.
    """
    open_, stacks = np.zeros(capacity + 1, dtype=np.int64), [[] for _ in range(capacity + 1)]
    for s in sorted((s for s, c in counts.items() if c > 0), reverse=True):
        todo = int(counts[s])
        gaps = np.arange(s, capacity + 1)
        after = gaps - s
        while todo:
            n = open_[gaps]
            cost = np.where(n > 0, np.where(after > 0, 2 * (open_[after] - n) + 2, 1 - 2 * n), NONE)
            if int(cost.min()) == NONE:
                _opened(open_, stacks, s, todo, capacity)
                break
            movers, rounds = _round(open_, gaps, after, cost, todo, capacity)
            for g in gaps[movers][::-1].tolist():  # descending: a gap that others fill up gets theirs first
                moved = _taken(stacks[g], rounds, s)
                stacks[g - s] += moved
                open_[g] -= rounds
                if g > s:
                    open_[g - s] += rounds
            todo -= rounds * len(movers)
    return [x for stack in stacks for x in stack]


def _opened(open_: np.ndarray, stacks: list[list], s: int, todo: int, capacity: int) -> None:
    """New sequences for todo pieces of length s: each is filled before the next is opened, as it then is the only one with room."""
    full, rest = divmod(todo, capacity // s)
    for n, held in ((full, capacity // s), (1, rest)):
        if n and held:
            gap = capacity - held * s
            stacks[gap].append((n, [s] * held))
            if gap:
                open_[gap] += n


def _round(open_: np.ndarray, gaps: np.ndarray, after: np.ndarray, cost: np.ndarray, todo: int, capacity: int) -> tuple[np.ndarray, int]:
    """Places in gaps that move now, and how many pieces each takes before another gap would be as good."""
    k = int(cost.argmin())  # the smaller gap left wins ties
    first = int(cost[k])
    movers = np.flatnonzero(cost < first + 4)  # a move makes the next one from its gap dearer by 4
    movers = movers[:1] if k == 0 else movers[movers > 0]  # a perfect fit (place 0), dearer by 2 each time, goes by itself
    change = np.zeros(capacity + 1, dtype=np.int64)  # of open sequences by gap, in a round
    np.add.at(change, after[movers], 1)
    change[gaps[movers]] -= 1
    fed = change[gaps[movers]] >= 0  # gaps that get as many as they give
    rise = 2 * (np.where(after > 0, change[after], 0) - change[gaps])
    most = int(rise[movers].max())
    rounds = min([todo // len(movers), *open_[gaps[movers][~fed]].tolist()])
    others = cost < NONE
    others[movers] = False
    if others.any():
        rounds = min(rounds, int(((cost[others] - first) // np.maximum(most - rise[others], 1)).min()))
    if todo < len(movers):
        movers = np.sort(movers[np.lexsort((after[movers], cost[movers]))[:todo]])
    return movers, max(rounds, 1)


def _taken(stack: list[tuple[int, list[int]]], n: int, s: int) -> list[tuple[int, list[int]]]:
    """n sequences off the stack, each with a piece of length s more."""
    moved = []
    while n:
        have, lengths = stack.pop()
        if have > n:
            stack.append((have - n, lengths))
            have = n
        moved.append((have, [*lengths, s]))
        n -= have
    return moved


def _lookup(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """For each (length, first rank) in order: the first sequence, the offset and the stride within one sequence group."""
    rows, first, used = [], 0, {}
    for n, lengths in plan:
        offset = 0
        for s in lengths:
            rows.append((s, used.get(s, 0), first, offset))
            used[s] = used.get(s, 0) + n
            offset += s
        first += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0] << 40 | table[:, 1], table[:, 2], table[:, 3]


def added_tokens(json_path: str) -> dict[str, int]:
    """Added tokens of a tokenizers file, which texts are split at; only those that match literally, anywhere in a text."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take in or depend on what is around them are not supported")
    return {t["content"]: t["id"] for t in added}


def best_fit_pack(docs: DataFrame, ranks_path: str, pattern: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces with their places: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, binary, if wanted).

    added has tokens that are matched in texts before the pattern is.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern, added or {}))
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids binary" * with_ids

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks, split, special = shared.value
        encoding = tiktoken.Encoding("packing", pat_str=split, mergeable_ranks={p: r for p, r in ranks.items() if r not in special.values()}, special_tokens=special)
        encode = lambda text: encoding.encode(text, allowed_special="all") if any(t in text for t in special) else encoding.encode_ordinary(text)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for frame in frames:
            rows = []
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    rows.append((key, i, a, b - a, zlib.crc32(raw), task, seen[b - a], *[raw] * with_ids))
                    seen[b - a] += 1
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids])

    cut = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInPandas(pieces, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long{extra}")
    cut = materialise(cut, "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = docs.sparkSession.sparkContext.broadcast(_lookup(pack_histogram(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, first, offset = plan.value
        for frame in frames:
            key = frame["length"].to_numpy() << 40 | frame["rank"].to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield frame.drop(columns="rank").assign(sequence_id=first[at] + key - keys[at], offset=offset[at])

    kept = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = cut.join(bases, ["length", "task"]).select(*kept, (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInPandas(place, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")
