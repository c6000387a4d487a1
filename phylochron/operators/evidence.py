"""Operators on weighted "donor before receptor" evidence: (donor, receptor, weight, distance, family, ingest_seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .trees import is_above


def distance_filter(evidence: DataFrame, least: float) -> DataFrame:
    """Rows farther apart than least, and rows of unknown distance."""
    return evidence.filter(F.col("distance").isNull() | (F.col("distance") > least))


def distance_report(evidence: DataFrame, least: float) -> DataFrame:
    """What the filter would do, in one row."""
    near = F.col("distance").isNotNull() & (F.col("distance") <= least)
    out = evidence.agg(
        F.count("*").alias("n_before"),
        F.count_if(~near).alias("n_kept"),
        F.count_if(near).alias("n_dropped"),
        F.count_if(F.col("distance").isNull()).alias("n_unknown"),
        F.count_if(near & (F.col("donor") == F.col("receptor"))).alias("n_self_dropped"),
    )
    return out.withColumn("ignored", (F.lit(least) > 0) & (F.col("n_dropped") == 0))


def edge_weights(evidence: DataFrame, *keys: str) -> DataFrame:
    """(donor, receptor, weight, first_seq): evidence summed by pair; first_seq breaks ties as the input order does."""
    return evidence.groupBy(*keys, "donor", "receptor").agg(F.sum("weight").alias("weight"), F.min("ingest_seq").alias("first_seq"))


def none_to_root(evidence: DataFrame, root) -> DataFrame:
    """Endpoints that read None stand for the root."""
    swap = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == "None"), F.lit(root)).otherwise(F.col(c))
    return evidence.withColumn("donor", swap("donor")).withColumn("receptor", swap("receptor"))


def hashed(mark: str, *columns):
    """A number in [0, 2**32) from columns with a mark between them, the same in every engine that has md5."""
    text = F.concat_ws(mark, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def coin(seed: int, *columns):
    """The same from a seed and key columns."""
    return hashed(":", F.lit(str(seed)), *columns)


def randomize_direction(evidence: DataFrame, seed: int) -> DataFrame:
    """Each row keeps or swaps its direction by a coin of its ingest_seq."""
    heads = coin(seed, "ingest_seq") < (1 << 31)
    return evidence.withColumn("_d", F.when(heads, F.col("receptor")).otherwise(F.col("donor"))).withColumn("receptor", F.when(heads, F.col("donor")).otherwise(F.col("receptor"))).withColumn("donor", F.col("_d")).drop("_d")


def randomize_endpoints(evidence: DataFrame, labels: list, seed: int) -> DataFrame:
    """Each row gets two different labels by coins of its ingest_seq; labels: the internal nodes of one tree."""
    if len(labels) < 2:
        raise ValueError("two internal nodes at least are needed")
    pool, n = F.array(*[F.lit(x) for x in labels]), len(labels)
    one = coin(seed, "ingest_seq", F.lit("d")) % n
    two = (one + 1 + coin(seed, "ingest_seq", F.lit("r")) % (n - 1)) % n
    return evidence.withColumn("donor", F.element_at(pool, (one + 1).cast("int"))).withColumn("receptor", F.element_at(pool, (two + 1).cast("int")))


def threshold(edges: DataFrame, share, *keys: str) -> DataFrame:
    """edges without the lightest: in order of weight and first appearance a row goes while the weight before it is
    below share * total. share: a number or a column."""
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("weight").over(by.orderBy("weight", "first_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("weight").over(by)
    return edges.withColumn("_before", before).withColumn("_total", total).filter(F.col("_before") >= F.col("_total") * share).drop("_before", "_total")


def with_relations(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """edges with what the numbered tree says of each pair: each end brings its interval, and ends are compared by these."""
    info = lambda side, *more: tree.select(F.col("label").alias(side), *[F.col(c).alias(f"{side}_{n}") for c, n in (("is_leaf", "leaf"), ("first", "first"), ("last", "last"), *more)])
    out = edges.join(info("donor"), "donor", "left").join(info("receptor", ("parent", "parent")), "receptor", "left")
    out = out.withColumn("down", is_above(F.col("donor_first"), F.col("donor_last"), F.col("receptor_first"))).withColumn("up", is_above(F.col("receptor_first"), F.col("receptor_last"), F.col("donor_first")))
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("donor_leaf", "receptor_leaf")})


def classify(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """edges with kind: the first of tree_edge, itself, desc, to_leaf, from_leaf, anc and info that holds.

    tree_edge: the tree's own edge between internal nodes, which no order can violate.
    """
    hard = (F.col("receptor_parent") == F.col("donor")) & ~F.col("receptor_leaf")
    kind = F.when(hard, "tree_edge").when(F.col("donor") == F.col("receptor"), "itself").when(F.col("down"), "desc").when(F.col("receptor_leaf"), "to_leaf").when(F.col("donor_leaf"), "from_leaf").when(F.col("up"), "anc").otherwise("info")
    return with_relations(edges, tree).select(*[F.col(c) for c in edges.columns], kind.alias("kind"))


def class_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def informative(classified: DataFrame) -> DataFrame:
    """Edges that an order can decide: kind info, weight not 0."""
    return classified.filter("kind = 'info' AND weight <> 0").drop("kind")


def trivial_conflict(classified: DataFrame) -> DataFrame:
    """(weight): what every order violates: edges to ancestors, and of each soft pair of opposite edges the lighter.

    Known double counts are kept for comparability: equal opposites count both, a self loop is its own opposite, and
    an edge to an ancestor may count again; reciprocal_excess() is the clean figure.
    """
    soft = classified.filter("kind <> 'tree_edge'")
    other = soft.select(F.col("receptor").alias("donor"), F.col("donor").alias("receptor"), F.col("weight").alias("back"))
    pairs = soft.join(other, ["donor", "receptor"], "left")
    lost = F.when(F.col("kind") == "anc", F.col("weight")).otherwise(F.lit(0)) + F.when(F.col("weight") >= F.col("back"), F.col("back")).otherwise(F.lit(0))
    return pairs.agg(F.sum(lost).alias("weight"))


def reciprocal_excess(edges: DataFrame, *keys: str) -> DataFrame:
    """edges with net: the weight beyond that of the opposite edge, 0 at least; a self loop keeps its weight."""
    other = edges.select(*keys, F.col("receptor").alias("donor"), F.col("donor").alias("receptor"), F.col("weight").alias("back"))
    net = F.when(F.col("donor") == F.col("receptor"), F.col("weight")).otherwise(F.greatest(F.col("weight") - F.coalesce("back", F.lit(0)), F.lit(0)))
    return edges.join(other, [*keys, "donor", "receptor"], "left").withColumn("net", net).drop("back")


def clade(tree: DataFrame, root) -> DataFrame:
    """(label, in, above): the nodes of the clade of root, and the strict ancestors of root, by the intervals of a numbered tree;
    without root in the tree there are none."""
    at = tree.filter(F.col("label") == (root if isinstance(root, Column) else F.lit(root))).select("first", "last").first()
    if at is None:
        return tree.limit(0).select("label", F.lit(True).alias("in"), F.lit(True).alias("above"))
    first, last = F.lit(at["first"]), F.lit(at["last"])
    inside = is_above(first, last, F.col("first"))
    return tree.select("label", inside.alias("in"), (is_above(F.col("first"), F.col("last"), first) & ~inside).alias("above")).filter(F.col("in") | F.col("above"))


def prune(evidence: DataFrame, tree: DataFrame, root, map_ancestors: bool = False) -> DataFrame:
    """Evidence within the clade of root. With map_ancestors a strict ancestor of root stands for root, and then
    rows from root to itself or from anywhere to root go."""
    flags = clade(tree, root)
    if not map_ancestors:
        inside = flags.filter("in").select("label")
        for side in ("donor", "receptor"):
            evidence = evidence.join(inside.withColumnRenamed("label", side), side, "left_semi")
        return evidence
    out = evidence
    for side in ("donor", "receptor"):
        out = out.join(flags.select(F.col("label").alias(side), F.col("in").alias(f"_{side}_in"), F.col("above").alias(f"_{side}_above")), side)
    out = out.withColumn("donor", F.when(F.col("_donor_above"), F.lit(root)).otherwise(F.col("donor"))).withColumn("receptor", F.when(F.col("_receptor_above"), F.lit(root)).otherwise(F.col("receptor")))
    return out.filter(F.col("receptor") != F.lit(root)).select(*evidence.columns)


def hard_hits(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence edges that coincide with a tree edge between internal nodes."""
    tree = nodes.filter("parent IS NOT NULL AND NOT is_leaf").select(F.col("parent").alias("donor"), F.col("label").alias("receptor"))
    return edges.join(tree, ["donor", "receptor"], "left_semi")


def unknown_endpoints(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, n): endpoints that the tree does not have."""
    ends = evidence.select(F.explode(F.array("donor", "receptor")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return ends.join(nodes.select("label"), "label", "left_anti")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """The bag union of evidence in the order given; fails if weights of different meaning would be added."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if "weight_semantics" in out.columns:
        kinds = [r[0] for r in out.select("weight_semantics").filter("weight_semantics IS NOT NULL").distinct().limit(3).collect()]
        if len(kinds) > 1:
            raise ValueError(f"weights of different meaning: {sorted(kinds)}")
    return out


#: A sum that has reached this is not added to.
SENTINEL = 1e10


def saturating_weights(evidence: DataFrame, most: float = SENTINEL) -> DataFrame:
    """(donor, receptor, weight, first_seq): evidence summed by pair in the order of ingest_seq until the sum is `most` or more;
    what comes later is not added. Weights are not negative, so only pairs whose whole sum reaches that depend on the order,
    and only their rows are run through: numbered once, then summed in blocks."""
    whole = edge_weights(evidence)
    full = whole.filter(F.col("weight") >= most).select("donor", "receptor")
    rows = evidence.select("donor", "receptor", "weight", "ingest_seq").join(full, ["donor", "receptor"], "left_semi")
    at = scans.ranked(rows, "_at", "ingest_seq")
    before = scans.running(at, ["donor", "receptor"], "_at", {"_before": F.col("weight")})
    cut = edge_weights(before.filter(F.col("_before") < most))
    return whole.filter(F.col("weight") < most).unionByName(cut)
