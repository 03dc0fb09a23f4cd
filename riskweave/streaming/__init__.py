"""The same decisions over a stream: rows are scored one by one, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.analyze import rule_decisions


def decisions_stream(spark: SparkSession, path: str, schema, text: str = "text") -> DataFrame:
    """A streaming DataFrame of decisions over Parquet files that appear under path."""
    return rule_decisions(spark.readStream.schema(schema).parquet(path), text)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; started again with the same checkpoint, it goes on where it ended."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
