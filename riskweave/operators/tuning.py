"""Sweeps and selections: thresholds, blends, temperatures, epochs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import blended, clip, sigmoid
from .metrics import confusion, rates, with_prediction

THRESHOLDS = tuple(i / 100 for i in range(5, 100, 5))
ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)


def _each(df: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    """Every row once for each of a fixed list of values."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def threshold_sweep(df: DataFrame) -> DataFrame:
    """f1, recall, precision and false positive rate of y, p at each threshold; one pass, rows are not multiplied."""
    y = F.col("y") == 1
    aggregates = [F.struct(F.lit(t).alias("threshold"), F.count_if(y & (F.col("p") >= t)).alias("tp"), F.count_if(~y & (F.col("p") >= t)).alias("fp"), F.count_if(y & ~(F.col("p") >= t)).alias("fn"), F.count_if(~y & ~(F.col("p") >= t)).alias("tn")) for t in THRESHOLDS]
    counted = df.agg(F.array(*aggregates).alias("curve")).select(F.inline("curve"))
    return rates(counted).select("threshold", "f1", "recall", "precision", F.col("false_positive_rate").alias("fpr"))


def first_by(df: DataFrame, *order) -> DataFrame:
    """The one row that comes first."""
    return df.orderBy(*order).limit(1)


def best_threshold(curve: DataFrame) -> DataFrame:
    return first_by(curve, F.desc("f1"), "fpr", "threshold")


def blend_sweep(df: DataFrame, *by: str) -> DataFrame:
    """f1, recall and false positive rate of blends of p0 and p1 at each alpha."""
    mixed = _each(df, "alpha", ALPHAS).withColumn("p", blended(F.col("p0"), F.col("p1"), F.col("alpha")))
    return rates(confusion(with_prediction(mixed), "alpha", *by)).select("alpha", *by, "f1", "recall", F.col("false_positive_rate").alias("fpr"))


def best_blend(sweep: DataFrame, gate: float = 0.95) -> DataFrame:
    """The alpha of best external f1 among those whose synthetic f1 reaches the gate; the smallest on ties."""
    wide = sweep.groupBy("alpha").agg(F.max(F.when(F.col("part") == "synthetic", F.col("f1"))).alias("synthetic_f1"), F.max(F.when(F.col("part") == "external", F.col("f1"))).alias("external_f1"))
    return first_by(wide.where(F.col("synthetic_f1") >= gate), F.desc("external_f1"), "alpha")


def temperature_grid(df: DataFrame, *by: str, points: int = 36, low: float = 0.3, high: float = 10.0) -> DataFrame:
    """Temperature of least negative log-likelihood on a logarithmic grid, from y and z in one pass; 1 where y has one class."""
    grid = [round(low * math.exp(i * math.log(high / low) / (points - 1)), 6) for i in range(points)]
    q = lambda t: clip(sigmoid(F.col("z") / t))
    losses = F.array(*[F.struct((-F.avg(F.when(F.col("y") == 1, F.ln(q(t))).otherwise(F.ln(1 - q(t))))).alias("nll"), F.lit(t).alias("temperature")) for t in grid])
    fitted = df.groupBy(*by).agg(F.array_min(losses).alias("best"), F.min("y").alias("low"), F.max("y").alias("high"))
    return fitted.select(*by, F.when(F.col("low") == F.col("high"), F.lit(1.0)).otherwise(F.col("best.temperature")).alias("temperature"))


def temperature_fit(df: DataFrame, *by: str, refinements: int = 2, points: int = 24, low: float = 0.3, high: float = 10.0) -> DataFrame:
    """Temperature of least negative log-likelihood between low and high: the grid's best, then finer grids around the best.

    Each refinement lays `points` steps, equal in ratio, between the neighbours of the best so far, so that the result is
    within a thousandth of the minimum; rows are read once for each.  1 where y has one class.
    """
    step = (high / low) ** (1 / 35)
    fitted = temperature_grid(df, *by, low=low, high=high).withColumnRenamed("temperature", "_t")
    kept = df.select(*by, "y", "z")
    classes = kept.groupBy(*by).agg((F.min("y") < F.max("y")).alias("_two"))
    for _ in range(refinements):
        around = fitted.select(*by, F.greatest(F.col("_t") / step, F.lit(low)).alias("_low"), F.least(F.col("_t") * step, F.lit(high)).alias("_high"))
        rows = kept.join(around, list(by)) if by else kept.crossJoin(F.broadcast(around))  # without groups it is one row
        at = lambda i: F.col("_low") * F.pow(F.col("_high") / F.col("_low"), F.lit(i / points))  # noqa: E731, B023
        q = lambda i: clip(sigmoid(F.col("z") / at(i)))  # noqa: E731, B023
        losses = F.array(*[F.struct((-F.avg(F.when(F.col("y") == 1, F.ln(q(i))).otherwise(F.ln(1 - q(i))))).alias("nll"), F.min(at(i)).alias("t")) for i in range(points + 1)])
        fitted = rows.groupBy(*by).agg(F.array_min(losses)["t"].alias("_t"))
        step = step ** (2 / points)
    joined = fitted.join(classes, list(by)) if by else fitted.crossJoin(classes)
    return joined.select(*by, F.when(F.col("_two"), F.col("_t")).otherwise(F.lit(1.0)).alias("temperature"))


def best_epoch(history: DataFrame) -> DataFrame:
    return first_by(history, F.desc("validation_f1"), "epoch")


def first_in_group(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("at") <= n)
