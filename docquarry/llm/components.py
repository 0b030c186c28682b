"""Connected components of a table of links, by joins: nothing is gathered on the driver but a count for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns id, comp for each id in a link: the smallest id that can be reached. In each round a node
    takes the smallest label around it, and then its label's own label, so that chains shorten by half."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = table = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "id").select("id", "comp", F.least("comp", "near").alias("new"))
        hop = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        moved = lower.join(hop, "new", "left").select("id", "comp", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = materialise(moved, "labels")
        forget(table)
        table, labels = step, step.select("id", F.col("new").alias("comp"))
        if step.where("comp <> new").isEmpty():
            forget(edges)
            return labels
