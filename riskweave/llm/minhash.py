"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts: shingle set size, a 128-bit digest of the set, the low bits of each minimum packed into longs,
   and band keys of whole minima.  Documents of one digest are copies: they are one node, with a number of its own, and the
   text of the smallest id stands for it.  Links and components are those of nodes until ids are put in their place.
2. Band keys shared by several sets give buckets.  Each member is compared with its bucket's smallest member and with the
   one before it (in its lane, of which a large bucket has several): similarity is estimated from equal low bits, corrected for chance collisions, and those not clearly below the threshold are
   confirmed on full sets.  Confirmed links give first components.
3. In buckets that still hold several components, all members are compared by their packed bits in blocks, which return
   the components that may belong together; all members of such components are compared on full sets in blocks, which
   return the links that join components.  Members of a group's largest component are copied only to the blocks of the
   rest, so a large group of near copies that step 2 has joined costs rows in proportion to its members; what it has left
   apart costs rows with the square of its number over the block size.  Every candidate pair that could join two
   components is decided.

Defined results: words are runs of bytes other than ASCII white space, A-Z in lower case; fewer words than a shingle make
one shingle; no words or a null text give the empty set, linked with nothing; ids are taken as unique, repeated rows of one
id are copies; a null id never is the smallest of a group unless it is alone; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped as _groups
from .common import materialise, scratch
from .graph import connected_components

MEMO_WORDS, MEMO_BYTES = 200_000, 48  # entries of a memo, and the longest word in it: at most about 40 MB
BLOCK = 256  # rows compared with as many at once
LANE = 1024  # members of a bucket that one task orders
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingler(size: int) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its sorted distinct shingle hashes (64 bits)."""
    import xxhash

    class Memo(dict):
        def __missing__(self, word: bytes) -> int:
            h = xxhash.xxh3_64_intdigest(word)
            if len(word) <= MEMO_BYTES:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                self[word] = h
            return h

    memo = Memo()

    def shingles(text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(size, len(words))
        total = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            total = _mix(total * _MIX[2] + hashes[j : len(words) - n + 1 + j])
        return np.unique(total)

    return shingles


class Signer:
    """Minima of hashes, their packed low bits and their band keys."""

    def __init__(self, hashes: int, bits: int, bands: int, rows: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self._a = random.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        self._b = random.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        self._bits, self._bands, self._rows = bits, bands, rows

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self._a), np.iinfo(np.uint32).max, dtype=np.uint32)
        for i in range(0, len(shingles), 1024):
            part = shingles[i : i + 1024]
            low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            grid = np.multiply.outer(self._a, low)
            grid ^= high
            grid *= self._b[:, None]
            np.minimum(least, grid.min(axis=1), out=least)
        return least

    def packed(self, minima: np.ndarray) -> np.ndarray:
        per = 64 // self._bits
        low = (minima & np.uint32((1 << self._bits) - 1)).astype(np.uint64).reshape(-1, per)
        return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(self._bits)), axis=1).view(np.int64)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        grid = minima[: self._bands * self._rows].astype(np.uint64).reshape(self._bands, self._rows)
        key = np.arange(1, self._bands + 1, dtype=np.uint64)
        for j in range(self._rows):
            key = _mix(key * _MIX[2] + grid[:, j])
        return key.view(np.int64)


def equal_values(a: Column, b: Column, hashes: int, bits: int) -> Column:
    """How many of the packed low-bit values of two signatures are equal, by bit counts."""
    ones = sum(1 << i for i in range(0, 64, bits))
    ones = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)
    total = F.lit(0)
    for i in range(hashes * bits // 64):
        x = a[i].bitwiseXOR(b[i])
        differs = x
        for s in range(1, bits):
            differs = differs.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + F.bit_count(differs.bitwiseAND(ones))
    return F.lit(hashes) - total


def similarity_estimate(equal: Column, hashes: int, bits: int) -> Column:
    """Jaccard similarity corrected for low bits that are equal by chance."""
    chance = 1 / (1 << bits)
    return (equal / F.lit(hashes) - chance) / (1 - chance)


def minhash_components(docs: DataFrame, *, shingle: int = 5, similarity_percent: int = 80, hashes: int = 128, bits: int = 4, bands: int = 25, rows: int = 5, margin: float = 0.15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's n_shingles, component_id (smallest id reachable over links), kept (it is that id) and text_hash (xxhash64).

    Two documents are linked if 100 * |A and B| >= similarity_percent * |A or B|; margin is how far below that an estimate
    from the packed bits may lie for the pair to be confirmed (four standard errors by default).
    """
    with scratch() as tables:
        signed, known = _components(docs, shingle, similarity_percent, Signer(hashes, bits, bands, rows), (hashes, bits, margin), id_col, text_col)
        tables.keep(signed, known)
    placed = signed.select("id", "text_hash", "n_shingles", "digest").join(known, ["digest", "n_shingles"], "left")
    component = F.coalesce("component", "id")
    return placed.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), "text_hash")


def _components(docs: DataFrame, shingle: int, similarity_percent: int, signer: Signer, estimate: tuple[int, int, float], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows (id, text_hash, n_shingles, digest) and the component's smallest id of each digest, both written."""
    hashes, bits, margin = estimate
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("*", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text").alias("place"))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = shingler(shingle)
        for frame in frames:
            out = []
            for key, text, text_hash, place in frame.itertuples(index=False):
                found = shingles(text)
                least = signer.minima(found)
                out.append((key, text_hash, place, len(found), xxhash.xxh3_128_digest(found.tobytes()), signer.packed(least), signer.keys(least)))
            yield pd.DataFrame(out, columns=["id", "text_hash", "place", "n_shingles", "digest", "signature", "keys"])

    signed = materialise(texts.mapInPandas(sign, f"id {kind}, text_hash long, place long, n_shingles long, digest binary, signature array<long>, keys array<long>"), "signatures")
    # aggregates are written before rows join them, as Spark splits the large partitions of a join only where both sides are read
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "place")).alias("least")  # a null id stands for copies only where all are null
    copies = signed.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(least)
    copies = materialise(copies.select("digest", "n_shingles", F.col("least.id").alias("rep"), "least.place", F.monotonically_increasing_id().alias("node")), "copies")
    reps = signed.join(copies.select("place", "digest", "node"), ["place", "digest"]).dropDuplicates(["node"])
    sketches = materialise(reps.select(F.col("node").alias("id"), "n_shingles", "signature", "keys"), "sketches")

    exploded = sketches.select("id", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("size")).where("pivot < last")
    shared = materialise(shared, "buckets")
    lane = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / LANE)).cast("int")
    members = materialise(exploded.join(shared, "key").select("key", "pivot", "id", lane.alias("lane")), "members")

    sketch = lambda name: sketches.select(F.col("id").alias(name), F.struct("n_shingles", "signature").alias(f"{name}_sketch"))
    size_a, size_b = F.col("a_sketch.n_shingles"), F.col("b_sketch.n_shingles")
    fits = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * similarity_percent
    close = similarity_estimate(equal_values(F.col("a_sketch.signature"), F.col("b_sketch.signature"), hashes, bits), hashes, bits) >= similarity_percent / 100 - margin

    before = F.lag("id").over(Window.partitionBy("key", "lane").orderBy("id"))
    star = members.withColumn("before", before).where("id > pivot").select("id", F.explode(F.array_distinct(F.array("pivot", "before"))).alias("a"))
    star = star.select("a", F.col("id").alias("b")).distinct()
    star = star.join(sketch("b"), "b").join(sketch("a"), "a").where(fits & close).select("a", "b")
    bucketed = members.select(F.col("id").alias("node")).distinct().join(copies.select("node", "place"), "node")
    used = texts.hint("merge").join(bucketed.hint("merge"), "place").select("place", "node", "text")  # texts are dealt by place once, at every size
    used = materialise(used.dropDuplicates(["place", "node"]).select(F.col("node").alias("id"), "text"), "texts")
    first = _confirmed(star, used, shingle, similarity_percent)
    components = connected_components(first)

    label = components.select("id", F.col("component"))
    held = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    odd_keys = materialise(held.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key"), "odd-keys")
    held = held.join(odd_keys, "key", "left_semi").join(sketches.select("id", F.struct("n_shingles", "signature").alias("sketch")), "id")
    held = held.select("key", "id", "component", "sketch.n_shingles", "sketch.signature")
    near = materialise(_near_components(held, similarity_percent, margin, hashes, bits), "near")
    if not near.isEmpty():
        clusters = connected_components(near)
        inside = components.join(clusters.select(F.col("id").alias("component"), F.col("component").alias("cluster")), "component")
        alone = clusters.join(components.select("id"), "id", "left_anti").select(F.col("id").alias("component"), "id", F.col("component").alias("cluster"))
        second = materialise(_settled(inside.unionByName(alone), used, shingle, similarity_percent), "settled")
        tree = components.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        components = connected_components(tree.union(second))

    named = components.withColumnRenamed("id", "node").join(copies.select("node", "rep"), "node")
    named = materialise(named.groupBy("component").agg(F.min("rep").alias("least")), "named")
    known = copies.join(components.withColumnRenamed("id", "node"), "node", "left").join(named, "component", "left")
    known = materialise(known.select("digest", "n_shingles", F.coalesce("least", "rep").alias("component")), "known")
    return signed, known


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity_percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, written to the shared folder."""
    pairs = materialise(pairs, "pairs")
    side = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, kept = shingler(shingle), OrderedDict()

        def of(key: object, text: str) -> np.ndarray:
            if (key, len(text)) not in kept:
                kept[key, len(text)] = shingles(text)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key, len(text)]

        for frame in frames:
            hit = []
            for a, b, x, y in frame.itertuples(index=False):
                p, q = of(a, x), of(b, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(100 * both >= similarity_percent * (len(p) + len(q) - both))
            yield frame.loc[np.array(hit, dtype=bool), ["a", "b"]]

    return materialise(both.mapInPandas(confirm, f"a {kind}, b {kind}"), "confirmed")


def _blocked(rows: DataFrame, key: str) -> DataFrame:
    """rows with low and high: every two rows of a group of key that lie in different components meet in some block (key, low, high).

    Rows of one component needn't meet.  So a group's largest component is dealt into parts of about BLOCK rows (numbered
    below 0) that meet only the parts of the rest (0 and up), and these meet each other.  A row is copied once for each
    part that it meets: the largest component is copied as often as the rest has parts, not as it has parts itself.
    """
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy(key).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_main < n_all")
    sizes = sizes.select(key, "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("main_parts"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int").alias("rest_parts"))
    sizes = materialise(sizes, "sizes")
    in_main, hashed = F.col("component") == F.col("main"), F.xxhash64("id")
    part = F.when(in_main, -1 - F.pmod(hashed, F.col("main_parts"))).otherwise(F.pmod(hashed, F.col("rest_parts"))).cast("int")
    rest = F.sequence(F.lit(0), F.col("rest_parts") - 1)
    meets = F.when(in_main, rest).otherwise(F.concat(F.sequence(-F.col("main_parts"), F.lit(-1)), F.array_remove(rest, F.col("part"))))
    dealt = rows.join(sizes, key).withColumn("part", part).withColumn("other", F.explode(meets))
    return dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("main", "main_parts", "rest_parts", "part", "other")


def _forest(linked: np.ndarray, component: np.ndarray) -> list[tuple]:
    """Links between different components, only as many as it takes to join what `linked` joins: (position, position)."""
    root: dict = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(component[i]), find(component[j])
        if a != b:
            root[a] = b
            found.append((i, j))
    return found


def _near_components(held: DataFrame, similarity_percent: int, margin: float, hashes: int, bits: int) -> DataFrame:
    """Pairs of components (a, b) of which a bucket holds members whose estimate is not clearly below the threshold."""
    kind, chance = held.schema["component"].dataType.simpleString(), 1 / (1 << bits)
    ones = np.uint64(sum(1 << i for i in range(0, 64, bits)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _groups(frames, ["key", "low", "high"]):
            component, sizes = group["component"].to_numpy(), group["n_shingles"].to_numpy()
            if (component == component[0]).all():
                continue
            signature = np.stack(group["signature"].to_numpy()).view(np.uint64)
            differs = np.zeros((len(group), len(group)), dtype=np.int64)
            for word in signature.T:
                x = word[:, None] ^ word[None, :]
                folded = x.copy()
                for s in range(1, bits):
                    folded |= x >> np.uint64(s)
                differs += np.bitwise_count(folded & ones)
            close = (1 - differs / hashes - chance) / (1 - chance) >= similarity_percent / 100 - margin
            close &= np.minimum(sizes[:, None], sizes[None, :]) * 100 >= np.maximum(sizes[:, None], sizes[None, :]) * similarity_percent
            close &= component[:, None] != component[None, :]
            out += [(min(component[i], component[j]), max(component[i], component[j])) for i, j in _forest(close, component)]
        yield pd.DataFrame(out, columns=["a", "b"])

    dealt = _blocked(held, "key").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.select("key", "low", "high", "component", "n_shingles", "signature").mapInPandas(run, f"a {kind}, b {kind}").distinct()


def _settled(clusters: DataFrame, texts: DataFrame, shingle: int, similarity_percent: int) -> DataFrame:
    """Confirmed links (a, b) between components of one cluster (columns id, component, cluster): all members are compared in blocks."""
    kind = clusters.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, out = shingler(shingle), []
        for group in _groups(frames, ["cluster", "low", "high"]):
            component = group["component"].to_numpy()
            if (component == component[0]).all():
                continue
            sets = [shingles(t) for t in group["text"]]
            sizes, both = np.array([len(x) for x in sets]), np.zeros((len(sets), len(sets)))
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
            for start in range(0, int(column[-1]) + 1, 8192):  # a bounded slice of the shingles at a time
                at = slice(*np.searchsorted(column, [start, start + 8192]))
                grid = np.zeros((len(sets), 8192), dtype=np.float32)
                grid[owner[at], column[at] - start] = 1
                both += grid @ grid.T
            linked = 100 * both >= similarity_percent * (sizes[:, None] + sizes[None, :] - both)
            linked &= component[:, None] != component[None, :]
            ids = group["id"].to_numpy()
            out += [(ids[i], ids[j]) for i, j in _forest(linked, component)]
        yield pd.DataFrame(out, columns=["a", "b"])

    dealt = _blocked(clusters, "cluster").join(texts, "id").repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.select("cluster", "low", "high", "id", "component", "text").mapInPandas(run, f"a {kind}, b {kind}")
