"""Risk, severity and action heads over feature vectors, trained together by epochs of one pass each.

Rows have features (array<double>), risks (array of 0/1, one for each task), severity and action (class numbers), and
optionally teacher (array<double> of probabilities, null or not finite where there is none) and held (validation rows).

The loss is the mean of the tasks' binary cross entropies, plus a share of the two multinomial cross entropies, plus a share
of the cross entropy with the teacher's targets, cut to [0.01, 0.99], where they are on the label's side of one half.
An epoch is one aggregation over the table: the gradient of the training rows, as products of matrices that each task sums up
by feature, with the losses, and the counts of the validation rows at the weights the epoch began with.  The driver holds weights and sums, nothing of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ACTIONS, SEVERITIES, TASKS
from ..functions.scoring import binary_cross_entropy, log_sum_exp, sigmoid, teacher_usable
from ..functions.text import normalize
from .surrogate import hashed

PARTS = {"risks": len(TASKS), "severity": len(SEVERITIES), "action": len(ACTIONS)}  # logits of each head, in their order
LOGITS = sum(PARTS.values())


@dataclass
class Heads:
    """Weights, a row for each logit with the constant last, and the history of the epochs that made them."""

    weights: np.ndarray
    history: list[dict] = field(default_factory=list)
    selected: int = 0  # the epoch of the weights

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump({"weights": self.weights.tolist(), "history": self.history, "selected": self.selected}, file)

    @staticmethod
    def load(path: str) -> Heads:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        return Heads(np.array(stored["weights"], dtype=float), stored["history"], stored["selected"])


def _dense(features: pa.ListArray, width: int) -> np.ndarray:
    """A row of `width` numbers for each list; null lists and null elements count as 0, short lists are filled up with it."""
    lengths = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False)
    values = features.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    if lengths.max() > width:
        raise ValueError(f"features of more than {width} numbers")
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, in which zeros of a take no part, also where b is not finite."""
    if np.isfinite(b).all():
        return a @ b
    return sum((np.where(a[:, k, None] != 0, a[:, k, None] * b[k], 0.0) for k in range(a.shape[1])), np.zeros((a.shape[0], b.shape[1])))


def lists(rows: np.ndarray, none: np.ndarray) -> pa.ListArray:
    """A list for each row of numbers, null where `none` holds."""
    ends = np.cumsum([0, *np.where(none, 0, rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), pa.array(rows[~none].ravel()))


def logits(features: Column, weights: np.ndarray) -> Column:
    """array<double> of every head's logits, in the order of PARTS: a product of matrices for each batch of rows; null features give null."""

    @F.arrow_udf("array<double>")
    def scored(rows: pa.Array) -> pa.Array:
        z = _times(_dense(rows, weights.shape[1] - 1), weights[:, :-1].T) + weights[:, -1]
        return lists(z, rows.is_null().to_numpy(zero_copy_only=False))

    return scored(features)


def hashed_features(df: DataFrame, width: int, text: str = "text", to: str = "features") -> DataFrame:
    """df with the hashed word counts of its normalised texts, scaled to length 1; null and empty texts have zeros."""
    counted = hashed(df.withColumn("_norm", normalize(F.coalesce(F.col(text), F.lit("")))), "_norm", width)
    scaled = Normalizer(inputCol="features", outputCol="_scaled").transform(counted)
    return scaled.withColumn("_made", vector_to_array("_scaled")).drop("words", "features", "_norm", "_scaled").withColumnRenamed("_made", to)


def arrays(z: Column) -> dict[str, Column]:
    """The logit arrays of a decision record: risks, severity_logits and action_logits."""
    starts = np.cumsum([0, *PARTS.values()]).tolist()
    return {name if name == "risks" else f"{name}_logits": F.slice(z, start + 1, n) for (name, n), start in zip(PARTS.items(), starts, strict=False)}


def _errors(columns: list[str], head_weight: float) -> tuple[list[Column], list[Column], dict[str, Column]]:
    """What a row adds to the gradient of each logit by the labels and by the teacher, and to the sums of the epoch."""
    z, tasks = [F.get("_z", i) for i in range(LOGITS)], len(TASKS)
    label = [F.get("risks", i).cast("double") for i in range(tasks)]
    own = [(sigmoid(z[i]) - label[i]) / tasks for i in range(tasks)]
    loss = sum((binary_cross_entropy(z[i], label[i]) for i in range(tasks)), F.lit(0.0)) / tasks
    start = tasks
    for name in ("severity", "action"):
        part = F.slice("_z", start + 1, PARTS[name])
        total = log_sum_exp(part)
        for j in range(PARTS[name]):
            own.append(head_weight * (F.exp(z[start + j] - total) - F.when(F.col(name) == j, 1.0).otherwise(0.0)))
        loss = loss + head_weight * (total - F.get(part, F.col(name)))
        start += PARTS[name]
    sums, taught = {"loss": loss, "rows": F.lit(1.0)}, []
    if "teacher" in columns:
        target = [F.get("teacher", i) for i in range(tasks)]
        usable = [teacher_usable(t, y) for t, y in zip(target, label, strict=True)]
        cut = [F.least(F.greatest(t, F.lit(0.01)), F.lit(0.99)) for t in target]
        taught = [F.when(u, sigmoid(z[i]) - cut[i]).otherwise(0.0) for i, u in enumerate(usable)]
        sums["taught"] = sum((F.when(u, binary_cross_entropy(z[i], cut[i])).otherwise(0.0) for i, u in enumerate(usable)), F.lit(0.0))
        sums["targets"] = sum((u.cast("double") for u in usable), F.lit(0.0))
    return own, taught, sums


def epoch(rows: DataFrame, weights: np.ndarray, *, head_weight: float = 0.3, teacher_weight: float = 0.05, monitor: str = "prompt_injection") -> tuple[np.ndarray, dict]:
    """The gradient of the loss over the training rows, and loss, validation_f1 and counts, in one pass over rows."""
    width, at = weights.shape[1], TASKS.index(monitor)
    held = F.coalesce(F.col("held"), F.lit(False)) if "held" in rows.columns else F.lit(False)
    own, taught, sums = _errors(rows.columns, head_weight)
    scored = rows.withColumns({"_held": held, "_z": logits(F.col("features"), weights)})
    y, p = F.get("risks", at) == 1, F.get("_z", at) >= 0
    counts = {"tp": y & p, "fp": ~y & p, "fn": y & ~p}
    train = lambda c: F.when(F.col("_held"), 0.0).otherwise(c)
    parts = {f"_e{i}": train(c) for i, c in enumerate([*own, *taught])} | {f"_s_{n}": train(c) for n, c in sums.items()} | {f"_s_{n}": (F.col("_held") & c).cast("double") for n, c in counts.items()}
    errors = [n for n in parts if n.startswith("_e")]
    totals = [n for n in parts if n.startswith("_s_")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums: for each feature those of the errors times its values, for the constant's place also the totals."""
        by_feature, whole = np.zeros((width, len(errors))), np.zeros(len(totals))
        for batch in batches:
            e = np.column_stack([batch.column(n).fill_null(0.0).to_numpy(zero_copy_only=False) for n in errors])
            by_feature[:-1] += _times(_dense(batch.column("features"), width - 1).T, e)
            by_feature[-1] += e.sum(axis=0)
            whole += [batch.column(n).fill_null(0.0).to_numpy(zero_copy_only=False).sum() for n in totals]
        once = np.zeros((width, len(totals)))
        once[-1] = whole
        made = np.hstack([by_feature, once])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *(pa.array(c) for c in made.T)], ["_k", *errors, *totals])

    sums_of = ", ".join(["_k int", *(f"{n} double" for n in (*errors, *totals))])
    by_feature = scored.select("features", *[c.alias(n) for n, c in parts.items()]).mapInArrow(summed, sums_of).groupBy("_k")
    found = by_feature.agg(*[F.sum(n).alias(n) for n in (*errors, *totals)]).collect()  # a row for each feature
    gradient, teacher, total = np.zeros_like(weights), np.zeros((len(TASKS), width)), dict.fromkeys(totals, 0.0)
    for r in found:
        sums_ = [r[e] for e in errors]
        gradient[:, r["_k"]] = sums_[:LOGITS]
        if taught:
            teacher[:, r["_k"]] = sums_[LOGITS:]
        if r["_k"] == width - 1:
            total = {t: r[t] for t in totals}
    n, targets = max(total["_s_rows"], 1.0), total.get("_s_targets", 0.0)
    gradient /= n
    loss = total["_s_loss"] / n
    if targets:
        gradient[: len(TASKS)] += teacher_weight * teacher / targets
        loss += teacher_weight * total["_s_taught"] / targets
    tp, fp, fn = (total[f"_s_{c}"] for c in ("tp", "fp", "fn"))
    return gradient, {"train_loss": loss, "validation_f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0}


def train(rows: DataFrame, *, epochs: int = 10, rate: float = 0.1, start: np.ndarray | None = None, only: str | None = None, monitor: str = "prompt_injection", report: Callable[[dict], None] | None = None, **weights_of_loss: float) -> Heads:
    """Heads of the epoch of best validation f1 of the monitored task, the first on ties, with the history of all.

    Adam steps on the whole table's gradient.  `only` names a task whose head alone moves (fine-tuning), `start` has weights
    to begin with.  history has for each epoch the loss that its step began with and the f1 after it.  Without validation
    rows every f1 is 0, and the first epoch is taken.
    """
    rows = rows.where(F.col("features").isNotNull()).persist()  # features are made once; lost parts are made again
    try:
        return _trained(rows, epochs, rate, start, only, monitor, report, weights_of_loss)
    finally:
        rows.unpersist()


def _trained(rows: DataFrame, epochs: int, rate: float, start: np.ndarray | None, only: str | None, monitor: str, report: Callable[[dict], None] | None, weights_of_loss: dict[str, float]) -> Heads:
    width = (rows.agg(F.max(F.size("features"))).first()[0] or 0) + 1
    weights = np.zeros((LOGITS, width)) if start is None else np.array(start, dtype=float)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    history, best = [], None
    gradient, measured = epoch(rows, weights, monitor=monitor, **weights_of_loss)
    for n in range(1, epochs + 1):
        if only is not None:
            kept = np.zeros_like(gradient)
            kept[TASKS.index(only)] = gradient[TASKS.index(only)]
            gradient = kept
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        weights = weights - rate * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.999**n)) + 1e-8)
        before = measured
        gradient, measured = epoch(rows, weights, monitor=monitor, **weights_of_loss)
        history.append({"epoch": n, "train_loss": before["train_loss"], "validation_f1": measured["validation_f1"]})
        if report:
            report(history[-1])
        if best is None or measured["validation_f1"] > best[0]:
            best = measured["validation_f1"], n, weights
    return Heads(best[2] if best else weights, history, best[1] if best else 0)


def history_table(spark: SparkSession, heads: Heads) -> DataFrame:
    """A row for each epoch: epoch, train_loss, validation_f1 and whether its weights were taken."""
    rows = [(h["epoch"], h["train_loss"], h["validation_f1"], h["epoch"] == heads.selected) for h in heads.history]
    return spark.createDataFrame(rows, "epoch int, train_loss double, validation_f1 double, selected boolean")
