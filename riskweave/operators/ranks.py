"""Order statistics of groups, positions in a shuffled order and splits, without sorting a group or a table whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import ACCURACY, FINE, bin_of, prefix_starts, sketched_edges

EDGES = 1024  # a sketch's edges, between two or three of which a rank is looked for
MARGIN = 4 / ACCURACY  # more than a sketch's ranks can be off by


def _grouped(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Rows with a value: df with _g, the group, and _v, the value as a double."""
    group = F.struct(*[F.col(b).alias(b) for b in by]) if by else F.struct(F.lit(0).alias("_all"))
    return df.where(F.col(value).isNotNull()).select("*", group.alias("_g"), F.col(value).cast("double").alias("_v"))


def _bounded(rows: DataFrame, rank: Callable[[Column], Column], named: dict[str, Column]) -> DataFrame:
    """_g, the named aggregates, _rank, and _low and _high, values between which the rank's value lies; null: no bound."""
    edges = F.percentile_approx("_v", [i / EDGES for i in range(EDGES + 1)], ACCURACY).alias("_edges")
    span = rows.groupBy("_g").agg(edges, *[c.alias(a) for a, c in named.items()]).withColumn("_rank", rank(F.col("n")).cast("long"))
    at = lambda share, to: to(share * EDGES).cast("int")
    low, high = at(F.col("_rank") / F.col("n") - MARGIN, F.floor), at((F.col("_rank") + 1) / F.col("n") + MARGIN, F.ceil)
    return span.withColumns({"_low": F.when(low > 0, F.get("_edges", low)), "_high": F.when(high < EDGES, F.get("_edges", high))}).drop("_edges")


def value_at_rank(df: DataFrame, value: str, rank: Callable[[Column], Column], *by: str, also: dict[str, Column] | None = None) -> DataFrame:
    """by, n, the aggregates `also`, and `value`: the one at position rank(n), from 0, among each group's sorted values.

    Null values don't count; a group whose rank lies outside its values has a null.  Two passes with partial aggregation: a
    quantile sketch of each group gives bounds around the rank, however its values are spread; then values within the
    bounds, under half a per cent of a group, are counted by value, those below and above as one row each.
    """
    rows = _grouped(df, value, by)
    named = {"n": F.count("*"), **(also or {})}
    span = _bounded(rows, rank, named)
    bounds = span.select("_g", "_low", "_high")
    part = F.when(F.col("_v") < F.col("_low"), 0).when(F.col("_v") > F.col("_high"), 2).otherwise(1)
    placed = rows.select("_g", "_v").join(bounds, "_g").select("_g", part.alias("_part"), F.when(part == 1, F.col("_v")).alias("_v"))
    counted = placed.groupBy("_g", "_part", "_v").agg(F.count("*").alias("_n"))
    until = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part", "_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = counted.withColumn("_until", until).join(span.select("_g", "_rank"), "_g").where((F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_n")))
    exact = F.when(F.col("_part") == 1, F.col("_v")).otherwise(F.raise_error(F.lit("a quantile sketch was off by more than its accuracy")).cast("double"))
    found = hit.select("_g", exact.alias(value))
    return span.join(found, "_g", "left").select(*[F.col(f"_g.{b}").alias(b) for b in by], *named, value)


def values_at_ranks(df: DataFrame, value: str, ranks: Callable[[Column], Column], *by: str, cells: int = 256) -> DataFrame:
    """by and `value`, an array: the values at the positions ranks(n), an array of numbers from 0, of each group's sorted values.

    A quantile sketch cuts a group in cells, whose rows are counted; only values of cells that hold a rank are counted each.
    """
    rows = _grouped(df, value, by)
    span = rows.groupBy("_g").agg(sketched_edges(F.col("_v"), cells).alias("_edges"), F.count("*").alias("_n"))
    placed = rows.select("_g", "_v").join(span.select("_g", "_edges"), "_g").select("_g", "_v", bin_of(F.col("_v"), F.col("_edges"), cells).alias("_cell"))
    up_to = lambda by_, order: Window.partitionBy(*by_).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.groupBy("_g", "_cell").agg(F.count("*").alias("_n")).withColumn("_until", F.sum("_n").over(up_to(["_g"], "_cell")))
    wanted = span.select("_g", F.posexplode(ranks(F.col("_n"))).alias("_place", "_rank"))
    within = (F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_n"))
    hit = counted.join(wanted, "_g").where(within).select("_g", "_cell", "_place", (F.col("_rank") - F.col("_until") + F.col("_n")).alias("_rank"))
    inside = placed.join(hit.select("_g", "_cell").distinct(), ["_g", "_cell"]).groupBy("_g", "_cell", "_v").agg(F.count("*").alias("_n")).withColumn("_until", F.sum("_n").over(up_to(["_g", "_cell"], "_v")))
    found = inside.join(hit, ["_g", "_cell"]).where(within).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_place", "_v"))).alias("_found"))
    return found.select(*[F.col(f"_g.{b}").alias(b) for b in by], F.transform("_found", lambda x: x["_v"]).alias(value))


def hash_order(key: Column, seed: int) -> Column:
    """A number from 0 to 2**52 by the digest of key and seed, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 13), 16, 10).cast("double")


def shuffled_positions(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with `position`, from 0 on without gaps: a row's place in the hash order of key and seed, rows of one hash by key.

    Cells of the hash's range are counted and the counts summed up, then rows are numbered in their cell alone: one shuffle
    of the rows, in which no task holds more than about one of FINE parts.  Rows with a null key come first.
    """
    order = hash_order(F.col(key), seed)
    rows = df.select("*", order.alias("_order"), F.coalesce(F.floor(order / (1 << 52) * FINE), F.lit(0)).cast("int").alias("_cell"))
    starts = prefix_starts(rows.groupBy(F.col("_cell").alias("cell")).agg(F.count("*").alias("n")))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_order", key))
    placed = rows.withColumn("_inside", inside).join(F.broadcast(starts.withColumnRenamed("cell", "_cell")), "_cell")  # FINE rows at most
    return placed.withColumn("position", F.col("start") + F.col("_inside") - 1).select(*df.columns, "position")


def stratified_split(df: DataFrame, key: str, *strata: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `split`: in each stratum the share, rounded, of rows that come first in hash order is `val`, the rest `train`."""
    rows = df.withColumn("_order", hash_order(F.col(key), seed))
    edges = value_at_rank(rows, "_order", lambda n: F.round(n * share) - 1, *strata).select(*[F.col(s).alias(f"_{s}") for s in strata], F.col("_order").alias("_edge"))
    same = [rows[s].eqNullSafe(edges[f"_{s}"]) for s in strata]
    split = F.when(F.col("_order") <= F.col("_edge"), "val").otherwise("train")
    return rows.join(edges, same, "left").withColumn("split", split).drop("_order", "_edge", *[f"_{s}" for s in strata])


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """At most `rows` rows, those that come first in hash order, in that order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(rows)
