"""Connected components over links, as joins: no link or component is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that links (columns a, b) name; component is the smallest id reachable.

    Each round takes the least label among neighbours and then the label's own label, so labels jump along chains; it ends
    when no label changed.  Self links are allowed, repeated ones cost nothing, no links give an empty table.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        pulled = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = pulled.join(jump, "component").select("id", F.least("component", "root").alias("component"), (F.least("component", "root") != F.col("old")).alias("changed"))
        labels, before = materialise(after, "labels"), labels
        discard(before)
    discard(both)
    return labels.select("id", "component")
