"""Bins with any edges: a value's bin by binary search in a sorted array, edges from sketches or exact ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # a sketch's ranks are off by a share of one in so many at most
FINE, COARSE = 1 << 16, 1 << 8  # cells of prefix_starts, and groups of them


def bin_of(value: Column, edges: Column, most: int = 1 << 12) -> Column:
    """How many of the sorted edges (an array of at most `most`) are not above the value: 0 to their number; a null value is in bin 0.

    Edges are inner ones: bin i holds values from edge i - 1 on to below edge i, and the last bin is open above, so a value
    equal to the largest edge or the greatest score belongs to it.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(most, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(edges, low + step - 1) <= value, F.lit(False)), low + step).otherwise(low))


def sketched_edges(value: Column, cells: int) -> Column:
    """An aggregate: inner edges of about equally many values in each cell, from a mergeable quantile sketch of bounded size."""
    return F.percentile_approx(value, [i / cells for i in range(1, cells)], ACCURACY)


def prefix_starts(counts: DataFrame, cell: str = "cell", n: str = "n") -> DataFrame:
    """cell and start, the sum of n over all smaller cells; cells are numbers from 0 to below FINE, one row each.

    Sums run within groups of cells and over the groups, so no window takes in all rows, and work is bounded by FINE.
    """
    group = F.floor(F.col(cell) / (FINE // COARSE)).cast("int")
    inside = Window.partitionBy("_group").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(cell, n, group.alias("_group")).withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    totals = counts.groupBy(group.alias("_group")).agg(F.sum(n).alias("_n"))
    every = totals.agg(F.array_sort(F.collect_list(F.struct("_group", "_n"))).alias("g"))  # COARSE entries at most
    none = F.struct(F.array().cast("array<struct<_group: int, _base: bigint>>").alias("out"), F.lit(0).cast("long").alias("sum"))
    run = F.aggregate("g", none, lambda s, x: F.struct(F.array_append(s["out"], F.struct(x["_group"].alias("_group"), s["sum"].alias("_base"))).alias("out"), (s["sum"] + x["_n"]).alias("sum")))
    bases = every.select(F.inline(run["out"]))
    return placed.join(F.broadcast(bases), "_group").select(cell, (F.col("_base") + F.col("_inside")).alias("start"))
