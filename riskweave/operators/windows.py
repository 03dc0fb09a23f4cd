"""Windows over groups of any size: a large group is cut in ranges of its order, each with the rows before it that its frames reach into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bins import bin_of, sketched_edges

RANGE_ROWS = 1_000_000  # rows of a group that one task orders
RANGES = 4_096  # ranges of a group at most


def trailing_mean(df: DataFrame, value: str, order: str, *by: str, steps: int = 25, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with step and trailing_mean, the mean of the last `steps` values, at every steps-th row of a group.

    Groups of up to range_rows rows are windows each.  Where one is larger, groups are cut in ranges of about that size by a
    quantile sketch of their order (a number, date or time): a row's number is that in its range and the rows before the
    range, whose last steps - 1 are copied to it.  Rows of equal order are in one range, in any order; a null order is first.
    """
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= range_rows:
        window = Window.partitionBy(*by).orderBy(order)
        rows = df.withColumn("step", F.row_number().over(window).cast("long")).withColumn("trailing_mean", F.avg(value).over(window.rowsBetween(-(steps - 1), 0)))
        return rows.where(F.col("step") % steps == 0)
    group = F.struct(*[F.col(b).alias(b) for b in by]) if by else F.struct(F.lit(0).alias("_all"))
    rows = df.select("*", group.alias("_g"))
    ranged = ranges(rows, order, min(-(-largest // range_rows), RANGES), range_rows)
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_g", "_range").agg(F.count("*").alias("_n")).select("_g", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    halo = _halo(ranged, value, order, steps - 1)
    both = ranged.withColumn("_halo", F.lit(0)).unionByName(halo.withColumn("_halo", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy("_g", "_range").orderBy(F.desc("_halo"), order)
    rows = both.withColumns({"_at": F.row_number().over(window), "_copied": F.sum("_halo").over(window.rowsBetween(Window.unboundedPreceding, 0)), "trailing_mean": F.avg(value).over(window.rowsBetween(-(steps - 1), 0))})
    rows = rows.where("_halo = 0").join(starts, ["_g", "_range"]).withColumn("step", F.col("_start") + F.col("_at") - F.col("_copied"))
    return rows.where(F.col("step") % steps == 0).select(*df.columns, "step", "trailing_mean")


def ranges(rows: DataFrame, order: str, cells: int, range_rows: int) -> DataFrame:
    """rows with _range: 0 in groups (_g) of up to range_rows rows, else one of `cells` ranges of the order."""
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"), sketched_edges(F.col(order), max(cells, 2)).alias("_edges")).where(F.col("_n") > range_rows)
    cut = rows.join(sizes.select("_g", "_edges"), "_g", "left")
    return cut.withColumn("_range", bin_of(F.col(order), F.col("_edges"), max(cells, 2))).drop("_edges")


def _halo(ranged: DataFrame, value: str, order: str, rows: int) -> DataFrame:
    """_g, _range, order and value of the last `rows` rows before each range, from the last ones of the ranges before it."""
    last = F.row_number().over(Window.partitionBy("_g", "_range").orderBy(F.desc(order)))
    tails = ranged.select("_g", "_range", order, value).withColumn("_last", last).where(F.col("_last") <= rows)  # `rows` of a range at most
    in_order = Window.partitionBy("_g").orderBy("_range", F.desc("_last"))
    ends = tails.withColumn("_rows", F.collect_list(F.struct(order, value)).over(in_order.rowsBetween(-(rows - 1), 0))).where("_last = 1")
    following = ends.select("_g", F.lead("_range").over(Window.partitionBy("_g").orderBy("_range")).alias("_range"), "_rows").where("_range IS NOT NULL")
    return following.select("_g", "_range", F.inline("_rows"))
