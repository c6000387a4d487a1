"""Event counts of gene families: events (family, sample, donor, receptor), one row a transfer in a sampled history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import reciprocal_excess

#: How a count becomes a weight.
SEMANTICS = ("integer_count", "sample_support", "declared_support", "posterior_frequency")


def counts(events: DataFrame) -> DataFrame:
    """(family, donor, receptor, weight): how often each family has each edge."""
    return events.groupBy("family", "donor", "receptor").agg(F.count("*").alias("weight"))


def net_counts(family_counts: DataFrame) -> DataFrame:
    """Counts less those of the opposite edge in the same family."""
    return reciprocal_excess(family_counts, "family")


def larger_families(events: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """Events of families with more than least members; sizes (family, size). Families of unknown size stay."""
    out = events.join(sizes, "family", "left")
    return out.filter(F.col("size").isNull() | (F.col("size") > least)).drop("size")


def supported(family_counts: DataFrame, denominators: DataFrame, min_support: float = 0.0) -> DataFrame:
    """Weights count / denominator (family, denominator) and those above min_support; without a denominator the
    count is the weight and the semantics say so."""
    out = family_counts.join(denominators, "family", "left")
    weight = F.when(F.col("denominator") > 0, F.col("weight") / F.col("denominator")).otherwise(F.col("weight").cast("double"))
    kind = F.when(F.col("denominator") > 0, "sample_support").otherwise("integer_count")
    return out.withColumn("weight", weight).withColumn("weight_semantics", kind).filter(F.col("weight") > min_support)


def hit_rate(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seen, resolved, rate): events whose endpoints the tree has both."""
    known = nodes.select("label", F.lit(1).alias("hit"))
    out = events
    for side in ("donor", "receptor"):
        out = out.join(known.select(F.col("label").alias(side), F.col("hit").alias(f"_{side}")), side, "left")
    hit = F.col("_donor").isNotNull() & F.col("_receptor").isNotNull()
    return out.agg(F.count("*").alias("seen"), F.count_if(hit).alias("resolved")).withColumn("rate", F.round(F.col("resolved") / F.col("seen"), 6))


def parent_of_donor(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with the donor's parent as donor; donors without a parent, and receptors that are leaves, drop out."""
    up = nodes.filter("parent IS NOT NULL").select(F.col("label").alias("donor"), F.col("parent").alias("_p"))
    inner = nodes.filter("NOT is_leaf").select(F.col("label").alias("receptor"))
    return events.join(up, "donor").join(inner, "receptor", "left_semi").withColumn("donor", F.col("_p")).drop("_p")


def rollup(diagnostics: DataFrame, counters: list[str], lists: list[str]) -> DataFrame:
    """One row: counters added, lists joined without repeats."""
    return diagnostics.agg(*[F.sum(c).alias(c) for c in counters], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])
