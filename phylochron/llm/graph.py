"""Connected components of a links table, as a loop over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, stored=stored) -> DataFrame:
    """links (a, b) with a <> b; returns (node, component), the smallest node reachable, for every node of a link, as a table
    that `stored` has written.

    Each round every node takes the smallest label next to it and then its label's label, so chains halve and the loop ends;
    both steps are joins and partial aggregates, and a node with very many links is split by adaptive execution.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both", 8 + links.count() // 50_000)
    parts = 8 + both.count() // 200_000
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", parts)
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = label.select(F.col("node").alias("at"), F.col("label").alias("far"))
        step = step.join(jump, F.col("new") == F.col("at"), "left").select("node", "label", F.least(F.col("new"), F.coalesce("far", "new")).alias("new"))
        step = stored(step, "labels", parts)
        changed = step.filter("new <> label").limit(1).count()
        label = step.select("node", F.col("new").alias("label"))
        if not changed:
            return label.withColumnRenamed("label", "component")
