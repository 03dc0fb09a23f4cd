"""Heads trained in place of an encoder: logistic regressions on hashed words, one for each task."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 12


def hashed(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """df with `words` and their hashed counts, `features`; null texts have none."""
    words = Tokenizer(inputCol="_text", outputCol="words").transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return HashingTF(inputCol="words", outputCol="features", numFeatures=buckets).transform(words).drop("_text")


def fit_heads(rows: DataFrame, tasks: tuple[str, ...], text: str = "text", steps: int = 8, ridge: float = 0.01) -> dict[str, LogisticRegressionModel]:
    """One model for each task, a 0/1 column of rows; features are made once."""
    made = hashed(rows, text).select("features", *[F.col(t).cast("double").alias(t) for t in tasks]).persist()
    try:
        return {t: LogisticRegression(featuresCol="features", labelCol=t, maxIter=steps, regParam=ridge).fit(made) for t in tasks}
    finally:
        made.unpersist()


def score_heads(df: DataFrame, models: dict[str, LogisticRegressionModel], text: str = "text") -> DataFrame:
    """A score provider's risks: df with the models' logits, in their order."""
    scored = hashed(df, text)
    for task, model in models.items():
        model = model.copy()
        model.setRawPredictionCol(f"_raw_{task}").setProbabilityCol("").setPredictionCol("")
        scored = model.transform(scored)
    return scored.withColumn("risks", F.array(*[vector_to_array(f"_raw_{t}")[1] for t in models])).drop("words", "features", *[f"_raw_{t}" for t in models])


def save_heads(models: dict[str, LogisticRegressionModel], path: str) -> None:
    """One folder for each task."""
    for task, model in models.items():
        model.write().overwrite().save(f"{path}/{task}")


def load_heads(path: str, tasks: tuple[str, ...]) -> dict[str, LogisticRegressionModel]:
    return {t: LogisticRegressionModel.load(f"{path}/{t}") for t in tasks}
