"""Classification and calibration metrics over long tables with columns y (0 or 1) and p (score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import clip
from .bins import bin_of
from .ranks import value_at_rank

# Ten equal bins as floating-point steps of a tenth give them, so 0.3 lies in the third bin.
EDGES = tuple(i * 0.1 for i in range(10))


def with_prediction(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("pred", (F.col("p") >= threshold).cast("int"))


def confusion(df: DataFrame, *by: str) -> DataFrame:
    y, p = F.col("y") == 1, F.col("pred") == 1
    return df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined), false positive and negative rates and support from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    or_zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({
        "accuracy": or_zero(tp + tn, tp + fp + fn + tn), "precision": or_zero(tp, tp + fp), "recall": or_zero(tp, tp + fn), "f1": or_zero(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": fp / F.greatest(F.lit(1), fp + tn), "false_negative_rate": fn / F.greatest(F.lit(1), fn + tp), "support": tp + fn,
    })


def task_metrics(df: DataFrame, *by: str) -> DataFrame:
    return rates(confusion(df, *by)).drop("tp", "fp", "fn", "tn")


def macro(metrics: DataFrame, *columns: str) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(f"macro_{c}") for c in columns])


def bin_index(p: Column) -> Column:
    """Bin 0 to 9 of a score; 1 belongs to the last."""
    return sum(((p >= e).cast("int") for e in EDGES[1:]), F.lit(0))


def ece_bins(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, bin_index(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_p"))


def ece(df: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error: bins' shares times the distance of mean truth and mean score."""
    bins = ece_bins(df, *by)
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def ece_by_edges(df: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """ece and the number of bins that hold rows, by group; edges has by and an array of sorted inner edges, `edges`."""
    binned = df.join(edges, list(by)).withColumn("bin", bin_of(F.col("p"), F.col("edges")))
    bins = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_p"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins"))


def brier_nll(df: DataFrame, *by: str) -> DataFrame:
    p, y = clip(F.col("p")), F.col("y")
    return df.groupBy(*by).agg(F.avg((p - y) * (p - y)).alias("brier"), (-F.avg(F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("nll"))


def calibration(df: DataFrame, *by: str) -> DataFrame:
    """ece, brier and nll in one pass: sums by bin, then by group."""
    p, y = clip(F.col("p")), F.col("y")
    sums = {"_n": F.count("*"), "_y": F.sum("y"), "_p": F.sum("p"), "_brier": F.sum((p - y) * (p - y)), "_nll": -F.sum(F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))}
    bins = df.groupBy(*by, bin_index(F.col("p")).alias("bin")).agg(*[c.alias(a) for a, c in sums.items()])
    n = F.sum("_n")
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("_y") - F.col("_p"))) / n).alias("ece"), (F.sum("_brier") / n).alias("brier"), (F.sum("_nll") / n).alias("nll"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and upper median (element n // 2 of the sorted values) by group; no group is sorted whole."""
    found = value_at_rank(df, value, lambda n: F.floor(n / 2), *by, also={"mean": F.avg(value)})
    return found.select(*by, "mean", F.col(value).alias("p50"), "n")
