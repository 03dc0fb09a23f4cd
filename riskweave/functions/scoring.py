"""Scores from logits: calibration, evidence floors, confidence, heads, pooling and losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-7


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clip(p: Column, low: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(1 - low))


def logit(p: Column) -> Column:
    p = clip(p)
    return F.ln(p / (1 - p))


def calibrated(p: Column, temperature: Column) -> Column:
    return sigmoid(logit(p) / F.coalesce(temperature, F.lit(1.0)))


def blended(p: Column, q: Column, alpha: Column) -> Column:
    return sigmoid((1 - alpha) * logit(p) + alpha * logit(q))


def floored(score: Column, seen: Column, floor: float = 0.95) -> Column:
    return F.when(seen, F.greatest(score, F.lit(floor))).otherwise(score)


def top_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return 1 / F.aggregate(logits, F.lit(0.0), lambda s, z: s + F.exp(z - top))


def confidence(severity: Column, action: Column) -> Column:
    return F.least(top_softmax(severity), top_softmax(action))


def argmax(logits: Column) -> Column:
    """Index from 0 of the first largest logit."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def decoded(logits: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), argmax(logits) + 1)


def encoded(name: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), name).cast("int") - 1


def certainty(probabilities: Column) -> Column:
    widest = F.array_max(F.transform(probabilities, lambda p: F.abs(p - 0.5))) * 2
    return F.least(F.greatest(widest, F.lit(0.0)), F.lit(1.0))


def linear(x: Column, weight: Callable[[Column], Column]) -> Column:
    """Dot product of x with weights given by a function of the position."""
    return F.aggregate(F.transform(x, lambda v, k: v.cast("double") * weight(k)), F.lit(0.0), lambda s, v: s + v)


def masked_mean_pool(matrix: Column, mask: Column) -> Column:
    """Mean of the rows of a token matrix (array<array<double>>) that the mask (array of 0/1) keeps; without any, zeros.

    One fold over the tokens; null components and a null mask count as 0, tokens beyond the mask are left out.
    """
    kept = F.transform(F.arrays_zip(matrix.alias("t"), mask.alias("m")), lambda z: F.struct(z["t"].alias("t"), F.coalesce(z["m"].cast("double"), F.lit(0.0)).alias("m")))
    none = F.transform(F.get(matrix, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, none, lambda s, z: F.when(z["m"] == 0, s).otherwise(F.zip_with(s, z["t"], lambda a, x: a + F.coalesce(x, F.lit(0.0)) * z["m"])))
    count = F.greatest(F.aggregate(kept, F.lit(0.0), lambda s, z: s + z["m"]), F.lit(1.0))
    return F.transform(total, lambda x: x / count)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, z: s + F.exp(z - top)))


def binary_cross_entropy(z: Column, target: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * target + F.ln(1 + F.exp(-F.abs(z)))


def cross_entropy(logits: Column, index: Column) -> Column:
    return log_sum_exp(logits) - F.element_at(logits, index + 1)


def teacher_usable(teacher: Column, label: Column) -> Column:
    """A finite teacher probability on the same side of one half as the label."""
    return F.coalesce(~F.isnan(teacher) & (F.abs(teacher) < float("inf")) & ((teacher >= 0.5) == (label >= 0.5)), F.lit(False))
