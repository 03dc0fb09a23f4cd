"""Near-duplicate vectors by NN-descent within labels.

1. Equal vectors of a label are one vector with a multiplicity, the number of ids that have it.
2. A first neighbour graph comes from random-projection trees: vectors of one leaf are compared, each keeps its nearest.
   A large leaf is dealt in parts of bounded size that are compared pairwise: nearest within a part, and over all parts
   the links that join what the leaf's links connect.
3. Rounds of neighbours of neighbours until the lists settle: those in a list are compared with each other, both ways of
   an edge count, and lists keep their nearest.  A round takes the lists that the round before has changed.
4. A list whose every entry passes the threshold is saturated: more may pass than it holds.  Saturated lists take no part
   in further rounds; they are enlarged to the vector's whole component, which is compared in blocks that return counts and
   no pairs, as is every component of three or more.
5. Recall is audited by vector: bounded samples of all vectors, of those in small components and of those whose edges lie
   just above and just below the threshold are compared with all rows, and each vector counts alike, however many links it
   has.  So where any link was found, links are audited; where none was, the sample grows until it holds a link, covers the
   table or has AUDIT_MOST vectors.  While the mean share of links found is too low, over all sampled vectors or over those
   of few links, more trees are grown; labels that still miss links then are compared whole, in the blocks of large
   leaves.  The share and the number of links that it was measured on are returned.

Defined results: links need equal labels, not null, and equal lengths; null, empty and zero vectors and those with null or
non-finite components link with nothing; each row gives a row; equal rows of one id are one vector, and rows of one id that
differ are vectors of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped as _groups
from .common import materialise, scratch
from .graph import connected_components

PART = 512  # rows of a leaf compared at once
SPREAD = 1024  # rows of a component compared with as many at once
LEAF = 128  # rows that trees aim at in a leaf
LANES = 16  # parts that a hub's edges are first cut in
ATTEMPTS = 4  # growths of trees before labels are compared whole
AUDIT_MOST = 16_384  # vectors of each kind in the largest sample, which the driver holds: at most six times as many
CHUNK = 1024  # sampled vectors that a task compares at once


def _matrix(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, floor: float, threshold: float) -> list[tuple[int, int, float]]:
    """Edges (a, b, cosine) of each row to its k nearest from floor on, and edges of cosine 2 that join what links connect."""
    similar = x @ x.T
    np.fill_diagonal(similar, -1)
    if similar.max() < floor:
        return []
    near = np.argsort(-similar, axis=1, kind="stable")[:, :k]
    edges = [(int(ids[i]), int(ids[j]), float(similar[i, j])) for i, row in enumerate(near) for j in row if similar[i, j] >= floor]
    return edges + _joining(ids, similar >= threshold)


def _joining(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of cosine 2 that join what links (a symmetric matrix) connect: each row to the smallest id that it reaches."""
    root = np.full(len(ids), -1)
    for i in np.argsort(ids, kind="stable").tolist():
        if root[i] < 0 and linked[i].any():
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = i
    return [(int(ids[r]), int(ids[i]), 2.0) for i, r in enumerate(root) if r >= 0 and r != i]


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, neighbours: int = 8, rounds: int = 12, recall: float = 0.98, audit_rows: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 5) -> DataFrame:
    """Each vector's n_links (other vectors linked directly), component_id (smallest id reachable) and kept (it is that id).

    audited_recall is the share of audited_links, the links of sampled vectors, that was found: 1 where the sample is the
    whole table and has none, null where none of AUDIT_MOST sampled vectors of a larger table has any.
    Rounds end when lists settle, after `rounds` at the latest.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (norm > 0) & (norm < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), x.alias("x"), F.coalesce(usable, F.lit(False)).alias("usable"))
    digest = [F.xxhash64("label", "x").alias("h"), F.xxhash64(F.lit(seed), "label", "x").alias("g")]  # 128 bits that stand for label and vector
    valid = rows.where("usable").select("id", "label", "x", *digest)
    ids = valid.select("h", "g", "id")
    with scratch() as tables:
        copies = materialise(ids.distinct().groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "copies")
        one = valid.groupBy("h", "g").agg(F.first("x").alias("x"), F.first(F.xxhash64("label", F.size("x"))).alias("place"))

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                raw = [(v / np.linalg.norm(v)).tobytes() for v in map(np.asarray, frame["x"])]
                yield pd.DataFrame({"id": frame["rep"], "place": frame["place"], "copies": frame["copies"], "raw": raw})

        reps = materialise(one.join(copies, ["h", "g"]).select("rep", "copies", "place", "x").mapInPandas(pack, "id long, place long, copies long, raw binary"), "vectors")
        total = reps.count()
        depth = max(1, int(np.ceil(np.log2(max(total, 1) / LEAF))))
        missed = 1 - (1 - np.arccos(threshold) / np.pi) ** depth
        trees = min(32, int(np.ceil(np.log(0.01) / np.log(missed))))
        floor = float(np.cos(min(2 * np.arccos(threshold), np.pi / 2)))
        edges, settled = None, None
        for attempt in range(ATTEMPTS):
            grown = materialise(_compare(_leaves(reps, trees, depth, seed + attempt), reps, neighbours, floor, threshold), "leaves")
            edges = grown if edges is None else edges.union(grown)
            edges, settled = _descend(edges, settled, reps, neighbours, rounds, floor, threshold)
            components = connected_components(edges.where(F.col("cosine") >= threshold).select("a", "b"))
            audit, found = _audited(reps, edges, components, threshold, audit_rows, neighbours, total)
            if found is None or found >= recall:
                break
        else:
            missing = audit.loc[audit["found"] < audit["links"], "place"].unique().tolist()  # at most as many as sampled vectors
            whole = _blocks(reps.where(F.col("place").isin(missing)).select("id", F.col("place").alias("leaf")))
            edges = edges.union(materialise(_compare(whole, reps, neighbours, floor, threshold), "whole"))
            components = connected_components(edges.where(F.col("cosine") >= threshold).select("a", "b"))
            audit, found = _audited(reps, edges, components, threshold, audit_rows, neighbours, total)
        counts = materialise(_enlarge(reps, components, threshold), "counts")
        same = copies.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
        same = materialise(same.select("h", "g", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "linked")
        tables.keep(same)
    known = ids.join(same, ["h", "g"]).select("id", "n_links", "component")  # both sides are read, so Spark can split the partition of a hot vector
    known = known.unionByName(rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    audited = [F.lit(int(audit["links"].sum())).cast("long").alias("audited_links"), F.lit(found).cast("double").alias("audited_recall")]
    return known.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"), *audited)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, cosine): each vector's k nearest by both ways of the edges; a hub's edges are first cut in LANES of their own."""
    both = edges.where("cosine < 1.5")
    both = both.select("a", "b", "cosine").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    both = both.withColumn("lane", F.pmod(F.xxhash64("b"), F.lit(LANES))).repartition("a", "lane").groupBy("a", "lane", "b").agg(F.max("cosine").alias("cosine"))
    for by in (["a", "lane"], ["a"]):
        both = both.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cosine"), "b"))).where(F.col("at") <= k)
    return both.select("a", "b", "cosine")


def _descend(edges: DataFrame, before: DataFrame | None, reps: DataFrame, k: int, rounds: int, floor: float, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """edges with those found by rounds of neighbours of neighbours, and the lists that were settled; before has earlier settled ones."""
    for _ in range(rounds):
        lists = materialise(_lists(edges, k), "lists")
        changed = (lists if before is None else lists.join(before, ["a", "b"], "left_anti")).select("a").distinct()
        saturated = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).where((F.col("n") < 2) | (F.col("n") >= k) & (F.col("least") >= threshold)).select("a")
        around = lists.join(changed, "a", "left_semi").join(saturated, "a", "left_anti").select(F.col("b").alias("id"), F.col("a").alias("leaf"), F.lit(0).alias("low"), F.lit(0).alias("high"))
        before = lists.select("a", "b")
        if around.isEmpty():
            break
        edges = edges.union(materialise(_compare(around, reps, k, floor, threshold), "round"))
    return edges, before


def _leaves(reps: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """(id, leaf, low, high): each vector's leaf in each tree, only leaves of several, in blocks as _blocks deals them."""

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(depth, dtype=np.int64)
        for frame in frames:
            by_size = frame.groupby(frame["raw"].map(len), sort=False)
            for size, part in by_size:
                planes = np.random.default_rng([seed, size]).standard_normal((size // 8, trees * depth))
                code = ((_matrix(part["raw"]) @ planes > 0).reshape(len(part), trees, depth) @ powers).astype(np.int64)
                yield pd.DataFrame({"id": part["id"], "place": part["place"], "codes": list(code)})

    coded = reps.select("id", "place", "raw").mapInPandas(codes, "id long, place long, codes array<long>")
    leaves = coded.select("id", "place", F.posexplode("codes")).select("id", F.xxhash64("place", "pos", "col").alias("leaf"))
    return _blocks(leaves)


def _blocks(leaves: DataFrame) -> DataFrame:
    """(id, leaf, low, high) of leaves of several rows, dealt in parts of about PART rows: any two parts meet in one block (low, high)."""
    parts = leaves.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = leaves.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.select("id", "leaf", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.select("id", "leaf", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def _compare(grouped: DataFrame, reps: DataFrame, k: int, floor: float, threshold: float) -> DataFrame:
    """Edges found among the rows of each (leaf, low, high); blocks of two parts give joining links alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, float]] = []
        for group in _groups(frames, ["leaf", "low", "high"]):
            if len(group) > 1:
                ids, x = group["id"].to_numpy(), _matrix(group["raw"])
                if group["low"].iloc[0] == group["high"].iloc[0]:
                    out += _nearest(ids, x, k, floor, threshold)
                else:
                    linked = x @ x.T >= threshold
                    np.fill_diagonal(linked, False)
                    out += _joining(ids, linked)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b", "cosine"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "cosine"]).astype({"a": "int64", "b": "int64", "cosine": "float64"})

    with_vectors = grouped.join(reps.select("id", "raw"), "id").repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high")
    return with_vectors.select("leaf", "low", "high", "id", "raw").mapInPandas(run, "a long, b long, cosine double").dropDuplicates(["a", "b"])


def _audited(reps: DataFrame, edges: DataFrame, components: DataFrame, threshold: float, audit_rows: int, few: int, total: int) -> tuple[pd.DataFrame, float | None]:
    """The audit and the recall by it, from a sample that grows while it holds no link."""
    while True:
        audit = _audit(reps, edges, components, threshold, audit_rows, few)
        found = _recall(audit, few)
        if found is None and audit_rows >= total:
            found = 1.0  # all vectors were compared with all
        if found is not None or audit_rows >= AUDIT_MOST:
            return audit, found
        audit_rows = min(8 * audit_rows, AUDIT_MOST)


def _audit(reps: DataFrame, edges: DataFrame, components: DataFrame, threshold: float, audit_rows: int, few: int) -> pd.DataFrame:
    """place, links and found (those that the components hold) of sampled vectors, by comparing them with all rows.

    At most audit_rows of all vectors are sampled, as many of those in components of at most `few`, and the ends of as many
    edges just above the threshold and just below it.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("members"))
    placed = reps.join(components.join(sizes, "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named, small = placed.select("id", "members"), F.coalesce("members", F.lit(1)) <= few
    order = [F.xxhash64("id"), F.col("id")]
    above, below = edges.where(F.col("cosine") >= threshold).orderBy("cosine", "a", "b"), edges.where(F.col("cosine") < threshold).orderBy(F.desc("cosine"), "a", "b")
    chosen = above.limit(audit_rows).union(below.limit(audit_rows)).select(F.explode(F.array("a", "b")).alias("id"))
    for rows in (named, named.where(small)):
        chosen = chosen.union(rows.orderBy(*order).limit(audit_rows).select("id"))  # ids alone are ordered, no vectors
    sample = placed.join(F.broadcast(chosen.distinct()), "id", "left_semi").select(placed.columns).toPandas()  # six times audit_rows at most
    chunks = [(int(p), part.iloc[at : at + CHUNK]) for p, part in sample.groupby("place") for at in range(0, len(part), CHUNK)]
    shared = reps.sparkSession.sparkContext.broadcast([(p, part["id"].to_numpy(), part["component"].to_numpy(), _matrix(part["raw"])) for p, part in chunks])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            by_place = dict(list(frame.groupby("place")))
            for place, ids, component, x in shared.value:
                part = by_place.get(place)
                if part is not None:
                    hit = (_matrix(part["raw"]) @ x.T >= threshold) & (part["id"].to_numpy()[:, None] != ids[None, :])
                    found = hit & (part["component"].to_numpy()[:, None] == component[None, :])
                    yield pd.DataFrame({"id": ids, "place": place, "links": hit.sum(axis=0), "found": found.sum(axis=0)})

    seen = placed.select("id", "place", "component", "raw").mapInPandas(run, "id long, place long, links long, found long")
    return seen.groupBy("id", "place").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).toPandas()


def _recall(audit: pd.DataFrame, few: int) -> float | None:
    """Mean share of links found by vector, over all audited vectors that have links or over those of at most `few`, whichever is less; None without links."""
    linked = audit[audit["links"] > 0]
    share = linked["found"] / linked["links"]
    return min((float(x.mean()) for x in (share, share[linked["links"] <= few]) if len(x)), default=None)


def _enlarge(reps: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): how many vectors of its component, copies counted, pass the threshold; components meet themselves in blocks."""
    sizes = materialise(components.groupBy("component").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts")), "sizes")
    held = components.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    held = held.select("id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = held.select("id", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    pairs = pairs.join(reps.select("id", "copies", "raw"), "id").repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts = [], []
        for group in _groups(frames, ["component", "low", "high"]):
            x, copies, own = _matrix(group["raw"]), group["copies"].to_numpy(), group["id"].to_numpy()
            if group["low"].iloc[0] == group["high"].iloc[0]:
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                ids.append(own)
                counts.append(hit @ copies)
            else:
                low = group["part"].to_numpy() == group["low"].iloc[0]
                hit = x[low] @ x[~low].T >= threshold
                ids += [own[low], own[~low]]
                counts += [hit @ copies[~low], hit.T @ copies[low]]
            if len(ids) > 2000:
                yield pd.DataFrame({"id": np.concatenate(ids), "linked": np.concatenate(counts)})
                ids, counts = [], []
        if ids:
            yield pd.DataFrame({"id": np.concatenate(ids), "linked": np.concatenate(counts)})

    found = pairs.select("component", "low", "high", "part", "id", "copies", "raw").mapInPandas(run, "id long, linked long")
    return found.groupBy("id").agg(F.sum("linked").alias("linked"))
