"""Centroid clustering of integer vectors with Hamerly's bounds.

Each vector keeps an upper bound of the distance to its centroid and one lower bound of that to any other.  Once centroids
have moved, the upper bound grows by the drift of the vector's own centroid and the lower one shrinks by the largest drift of
the others.  A vector whose upper bound is under its lower one, or under half the distance from its centroid to the nearest
other, keeps its cluster without a look at its components; where the bounds alone don't tell, the distance to its own
centroid makes the upper bound exact, and only vectors that are still ambiguous are compared with every centroid.

Compared distances are exact integers; bounds are rounded outward, so they never decide a tie.  A round writes vectors with
bounds and cluster to the shared folder, in the order in which they came: no shuffle.  Sums of centroids are kept
exactly and take in only the vectors that changed their cluster, added up by task, cluster and component first; the driver
holds centroids and their sums, nothing of the rows.

Defined results: vectors of another length, null ones and those with null or non-finite components are left out; rows are
clustered each, also repeated ones; rows with a null id take part but are no first centroids; of fewer vectors than centroids
each is one; ties in distance go to the smaller number; distances and sums that 64 bits can't hold are null; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

NARROW = 1 << 20  # components under it have distances that doubles and 64-bit integers hold exactly
LIMB = 40  # bits of a limb of a sum
MOST = (1 << 63) - 1
OUTWARD = 1e-9  # relative rounding of bounds


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): a matrix of int64 if all are under NARROW, else of Python integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * scale)
    if np.abs(whole).max(initial=0) < NARROW:
        return whole.astype(np.int64)
    exact = lambda v: math.floor(v * scale) if math.isfinite(v * scale) else math.floor(Fraction(v) * Fraction(scale))
    return np.array([[exact(v) for v in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if x.dtype == object or centroids.dtype == object:
        return np.stack([((x.astype(object) - c) ** 2).sum(axis=1) for c in centroids], axis=1) if len(x) else np.zeros((0, len(centroids)), dtype=object)
    f, c = x.astype(np.float64), centroids.astype(np.float64)  # whole numbers under 2 ** 53, so products and sums are exact
    return ((f * f).sum(axis=1)[:, None] - 2 * (f @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def own_squared(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid each."""
    if x.dtype == object or chosen.dtype == object:
        return ((x.astype(object) - chosen.astype(object)) ** 2).sum(axis=1)
    return ((x - chosen) ** 2).sum(axis=1)


def root(values: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of exact integers, rounded outward."""
    if values.dtype != object:
        plain = np.sqrt(values.astype(np.float64))
    else:
        whole = [math.isqrt(v) + up for v in values.tolist()]
        plain = np.array([float(r) if r.bit_length() <= 1000 else math.inf if up else 2.0**1000 for r in whole])
    return plain * (1 + OUTWARD if up else 1 - OUTWARD)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(i, part) with total = sum of part << (LIMB * i)."""
    sign, rest, i = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield i, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        i += 1


class _Centroids:
    """Centroids with what a round needs to know of them."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None):
        matrix = lambda r: np.array(r, dtype=np.int64 if all(abs(v) < NARROW for row in r for v in row) else object)
        self.rows = matrix(rows)
        k = len(rows)
        apart = squared(self.rows, self.rows)
        near = [min((apart[i, j] for j in range(k) if j != i), default=None) for i in range(k)]
        self.half = np.array([np.inf if v is None else root(np.array([v], dtype=apart.dtype), False)[0] / 2 for v in near])
        moved = np.zeros(k) if before is None else root(own_squared(self.rows, matrix(before)), True)
        self.drift = moved
        self.others = np.array([max((moved[j] for j in range(k) if j != i), default=0.0) for i in range(k)])


def _assigned(frame: pd.DataFrame, x: np.ndarray, c: _Centroids) -> pd.DataFrame:
    """frame with cluster, upper, lower and scans brought up to the centroids, and `was`, the cluster before."""
    was = frame["cluster"].to_numpy(dtype=np.int64)
    cluster, scans = was.copy(), frame["scans"].to_numpy(dtype=np.int64).copy()
    fresh = was < 0
    safe = np.where(fresh, 0, was)
    upper = np.where(fresh, np.inf, (frame["upper"].to_numpy() + c.drift[safe]) * (1 + OUTWARD))
    lower = np.where(fresh, 0.0, np.maximum(frame["lower"].to_numpy() - c.others[safe], 0) * (1 - OUTWARD))
    bound = np.maximum(lower, c.half[safe])
    near = np.flatnonzero(~fresh & (upper >= bound))
    upper[near] = root(own_squared(x[near], c.rows[was[near]]), True)
    scan = np.flatnonzero(upper >= bound)
    if len(scan):
        all_ = squared(x[scan], c.rows)
        best = np.array([min(range(len(row)), key=lambda i: (row[i], i)) for row in all_.tolist()]) if all_.dtype == object else all_.argmin(axis=1)
        at = np.arange(len(scan))
        cluster[scan], upper[scan] = best, root(all_[at, best], True)
        if len(c.rows) > 1:
            rest = np.array([min(v for j, v in enumerate(row) if j != b) for row, b in zip(all_.tolist(), best.tolist(), strict=True)], dtype=all_.dtype) if all_.dtype == object else _second(all_, best)
            lower[scan] = root(rest, False)
        else:
            lower[scan] = np.inf
        scans[scan] += 1
    return frame.assign(cluster=cluster, upper=upper, lower=lower, scans=scans, was=was)


def _second(distances: np.ndarray, best: np.ndarray) -> np.ndarray:
    rest = distances.copy()
    rest[np.arange(len(rest)), best] = MOST
    return rest.min(axis=1)


def hamerly_clusters(vectors: DataFrame, *, clusters: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and scans (how many of the rounds + 1 assignments compared the vector with every centroid)."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    usable = (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))
    name = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    first = kept.where(F.col("id").isNotNull()).select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(clusters).collect()  # as many rows as centroids
    rows = [[int(v) for v in quantised(np.array([r["x"]], dtype=np.float64), scale)[0]] for r in sorted(first, key=lambda r: r["h"])]
    out = [id_col, "cluster", "distance"]
    if not rows:
        kept = kept.where("false")
        rows = [[0] * width]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = np.array([*frame["x"]], dtype=np.float64).reshape(len(frame), width)
            with np.errstate(over="ignore"):
                whole = np.floor(values * scale)
            small = (np.abs(whole) < 1 << 15).all(axis=1).tolist()
            raw = [(w.astype(np.int16) if s else v).tobytes() for v, w, s in zip(values, whole, small, strict=True)]
            yield pd.DataFrame({"id": frame["id"], "raw": raw, "cluster": -1, "was": -1, "upper": 0.0, "lower": 0.0, "scans": 0})

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        """Quantised components: most rows hold them as 16-bit integers, the others their doubles."""
        small = (frame["raw"].map(len) == 2 * width).to_numpy(dtype=bool)
        grid = np.frombuffer(b"".join(frame.loc[small, "raw"]), dtype=np.int16).reshape(-1, width).astype(np.int64)
        if small.all():
            return grid
        large = quantised(np.frombuffer(b"".join(frame.loc[~small, "raw"]), dtype=np.float64).reshape(-1, width), scale)
        out = np.zeros((len(frame), width), dtype=large.dtype)
        out[small], out[~small] = grid, large
        return out

    state_schema = f"id {kind}, raw binary, cluster int, was int, upper double, lower double, scans int"

    def round_of(state: DataFrame, centroids: _Centroids) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield _assigned(frame, matrix(frame), centroids)[["id", "raw", "cluster", "was", "upper", "lower", "scans"]]

        return state.mapInPandas(run, state_schema)

    def sums_of(state: DataFrame) -> DataFrame:
        """cluster, place (a component, or -1 for the count), limb, part: what moved vectors add to sums and take from them."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[tuple[int, int], int] = {}
            for frame in frames:
                values = matrix(frame)
                for column, sign in (("cluster", 1), ("was", -1)):
                    at = frame[column].to_numpy()
                    for j in np.unique(at[at >= 0]).tolist():
                        held = values[at == j]
                        for d, v in enumerate([len(held), *held.sum(axis=0).tolist()]):
                            totals[j, d - 1] = totals.get((j, d - 1), 0) + sign * v
            yield pd.DataFrame([(j, d, i, part) for (j, d), v in totals.items() for i, part in _limbs(v)], columns=["cluster", "place", "limb", "part"], dtype=np.int64)

        moved = state.where("cluster <> was").select("raw", "cluster", "was")
        return moved.mapInPandas(run, "cluster int, place int, limb int, part long").groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))

    state, before = kept.mapInPandas(pack, state_schema), None
    sums = [[0] * (width + 1) for _ in rows]
    for _ in range(rounds):
        after = materialise(round_of(state, _Centroids(rows, before)), "assigned")
        if before is not None:
            discard(state)
        state = after
        for r in sums_of(state).collect():  # rows by cluster and component
            sums[r["cluster"]][r["place"] + 1] += r["part"] << (LIMB * r["limb"])
        before, rows = rows, [[v // s[0] for v in s[1:]] if s[0] else row for s, row in zip(sums, rows, strict=True)]
    last = _Centroids(rows, before)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = matrix(frame)
            done = _assigned(frame, values, last)
            distance = own_squared(values, last.rows[done["cluster"].to_numpy()])
            held = pd.array([v if v <= MOST else None for v in distance.tolist()], dtype="Int64")
            yield pd.DataFrame({id_col: done["id"], "cluster": done["cluster"], "distance": held, "scans": done["scans"]})

    done = materialise(state.mapInPandas(finish, f"{id_col} {kind}, cluster int, distance long, scans int"), "clusters")
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r["cluster"]: None if r["inertia"] is None else int(r["inertia"]) for r in done.groupBy("cluster").agg(whole.alias("inertia")).collect()}  # a row for each cluster
    fits = lambda v: v if v is not None and v <= MOST else None
    total = fits(None if None in inertia.values() else sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    of_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return done.select(*out, of_cluster([fits(inertia.get(i)) for i in range(len(rows))], "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"), "scans")
