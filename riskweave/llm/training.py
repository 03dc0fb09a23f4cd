"""A bounded sample of labelled rows, the same for every size of table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .minhash import shingler

SAMPLE_ROWS, SAMPLE_BYTES = 5_000, 64 << 20


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null ids have no fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], *, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, id_col: str = "doc_id") -> pd.DataFrame:
    """Up to `rows` labelled documents of up to `size` bytes together, in the order of a hash of the id: the given columns, y (0 or 1) and weight.

    labels has id_col and y; columns has "text".  Both bounds are the operators' documented parameters; of rows of one id
    the least by a hash of the text is taken, and texts longer than a sixteenth of `size` are left out of the sample.
    Copies and near copies share one unit of weight, so that a large group doesn't speak for its words.
    """
    chosen = labels.where(F.col("y").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("y").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.xxhash64(text).alias("_hash"), F.octet_length(text).alias("_size"), *columns)
    found = docs.where(F.octet_length(text) <= size // 16).select(id_col, row.alias("row")).join(F.broadcast(chosen), id_col)  # at most `rows` labels are broadcast
    found = materialise(found.groupBy(id_col, "y").agg(F.min("row").alias("row")).select(F.xxhash64(id_col).alias("_order"), id_col, "y", "row.*"), "sample")
    sizes = found.select("_order", id_col, "_size").toPandas().sort_values(["_order", id_col])  # at most `rows`, without texts
    kept = sizes.loc[sizes["_size"].cumsum() <= size, id_col].tolist()
    if len(kept) < len(sizes):
        found = found.where(F.col(id_col).isin(kept))
    sample = found.select(id_col, "y", *columns).toPandas().sort_values(id_col, ignore_index=True)
    discard(found)
    sample["text"] = sample["text"].fillna("")
    sample["weight"] = copy_weights(sample["text"])
    return sample


def copy_weights(texts: pd.Series) -> np.ndarray:
    """1 over the number of texts that share the least hash of three consecutive words."""
    shingles = shingler(3)
    least = [int(found[0]) if len(found := shingles(text)) else 0 for text in texts]
    key = pd.Series(least, dtype="uint64")
    return (1.0 / key.map(key.value_counts())).to_numpy(dtype=float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression on the columns of x and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
