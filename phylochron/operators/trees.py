"""Relations over a rooted tree: nodes (label, parent, is_leaf, length), one row a node, label unique.

`numbered` gives every node the interval of its subtree in preorder, so that whether one node is above another is two
comparisons of columns, whatever the depth; tables of all ancestor pairs are made only where they are the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import Steps
from . import ranges, scans


def heap_tree(spark: SparkSession, size: int = 63) -> DataFrame:
    """The complete binary tree 1..size with parent k // 2; node ids are labels, preorder is a sort key."""
    return heap_nodes(spark.range(1, size + 1).select(F.col("id").alias("k"), (1 + F.col("id") % 3).cast("long").alias("length")), size)


def heap_nodes(rows: DataFrame, size: int) -> DataFrame:
    """The same for rows (k, length), k from 1 to size."""
    k, bits, deep = F.col("k"), F.length(F.bin("k")), len(bin(size)) - 2
    return rows.select(
        k.alias("label"),
        F.when(k > 1, F.shiftright(k, 1)).alias("parent"),
        (k > size // 2).alias("is_leaf"),
        "length",
        (bits - 1).cast("long").alias("depth"),
        (F.expr(f"shiftleft(k, {deep} - length(bin(k)))") * 64 + bits).cast("long").alias("preorder"),
    )


#: Doublings of the tour that stay one plan, before its table is stored.
SHALLOW = 3


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with first and last (the numbers, in preorder from 0, of the nodes below each and itself), inner_first and inner
    (internal nodes before it in preorder; internal nodes below it and itself), depth, and dist (lengths added up from the root,
    whose own counts for nothing; null is 0). Children come in the order of column preorder, if there is one, or of label.

    The tree is walked round as a list of 2n steps, down to a node and up from it, each knowing the next. Pointers are doubled until
    all point behind the end, adding up what lies between: log(2n) joins, also for a tree that is one long path. Every pointer is a
    different key, so no join is skewed. Lengths are added as decimals, so equal ways have equal sums.
    """
    spark = nodes.sparkSession
    size = nodes.agg(F.count("*").alias("n"), F.count_if(~F.col("is_leaf")).alias("inner")).first()
    whole = "length" not in nodes.columns or nodes.schema["length"].dataType.typeName() in ("long", "integer", "short", "byte")
    exact = "long" if whole else "decimal(38,18)"
    length = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("length") if "length" in nodes.columns else F.lit(0), F.lit(0))).cast(exact)
    base = nodes.select("label", "parent", "is_leaf", length.alias("len"), F.col("preorder" if "preorder" in nodes.columns else "label").alias("_by"))
    family = Window.partitionBy("parent").orderBy("_by", "label")
    base = base.withColumn("_next", F.lead("label").over(family)).withColumn("_k", F.row_number().over(family))
    eldest = base.filter("parent IS NOT NULL AND _k = 1").select(F.col("parent").alias("label"), F.col("label").alias("_child"))
    base = base.join(eldest, "label", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    inner = F.when(F.col("is_leaf"), none).otherwise(one)
    step = lambda up, to, to_up, *sums: F.struct(F.lit(up).alias("up"), to.alias("to"), to_up.cast("int").alias("to_up"), *[s.alias(c) for s, c in zip(sums, SUMS, strict=True)])
    down = step(0, F.coalesce("_child", "label"), F.col("_child").isNull(), one, inner, one, F.col("len"))
    up = step(1, F.coalesce("_next", "parent"), F.col("_next").isNull(), none, none, -one, (-F.col("len")).cast(exact))
    tour = base.select("label", F.explode(F.array(down, up)).alias("s")).select("label", "s.*")
    with Steps(spark, "tree") as steps:
        tour, k, reached = steps.stored(tour, "tour"), 0, 1
        while reached < 2 * size["n"]:
            tour, k, reached = _doubled(tour), k + 1, 2 * reached
            if k % SHALLOW == 0 and reached < 2 * size["n"]:
                tour = steps.stored(tour, "tour")
        at = lambda side, c: F.max(F.when(F.col("up") == side, F.col(c)))
        both = tour.groupBy("label").agg(*[at(side, c).alias(f"{c}{side}") for c in SUMS for side in (0, 1)])
        first, inner_first = size["n"] - F.col("count0"), size["inner"] - F.col("inner0")
        numbers = both.select("label", first.alias("first"), (size["n"] - F.col("count1") - 1).alias("last"), inner_first.alias("inner_first"), (F.col("inner0") - F.col("inner1")).alias("inner"), (-F.col("depth0")).alias("depth"), (-F.col("len0")).alias("_above"))
        own = nodes.drop("first", "last", "inner_first", "inner", "depth", "dist").withColumn("_len", length)
        dist = (F.col("_above") + F.col("_len")).cast("long" if whole else "double")
        return steps.result(own.join(numbers, "label").withColumn("dist", dist).drop("_above", "_len"), "numbered")


#: What is added up along the tour: nodes, internal nodes, levels, lengths.
SUMS = ("count", "inner", "depth", "len")


def _doubled(tour: DataFrame) -> DataFrame:
    """The tour with pointers twice as far. A step whose pointer is behind the end asks for a key of its own that nobody has."""
    far = tour.select(F.col("label").alias("_at"), F.col("up").alias("_up"), F.col("to").alias("_to"), F.col("to_up").alias("_to_up"), *[F.col(c).alias(f"_{c}") for c in SUMS])
    own = tour.withColumn("_at", F.coalesce("to", "label")).withColumn("_up", F.when(F.col("to").isNull(), F.lit(2)).otherwise(F.col("to_up")))
    kind = tour.schema["len"].dataType
    sums = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast(kind if c == "len" else "long").alias(c) for c in SUMS]
    return own.join(far, ["_at", "_up"], "left").select("label", "up", F.col("_to").alias("to"), F.col("_to_up").alias("to_up"), *sums)


def is_above(first: Column, last: Column, other_first: Column) -> Column:
    """Whether a node with the interval first..last is the other node or above it; false where one is unknown."""
    return F.coalesce((first <= other_first) & (other_first <= last), F.lit(False))


def closure(tree: DataFrame) -> DataFrame:
    """(anc, des, hops) of every ancestor-or-self pair, which is what it lists; tree: numbered."""
    below = tree.select(F.col("first").alias("_n"), F.col("label").alias("des"), F.col("depth").alias("_d"))
    out = scans.spread(tree.select(F.col("label").alias("anc"), "first", "last", "depth"), F.col("first"), F.col("last") - F.col("first") + 1, "_n")
    return out.join(below, "_n").select("anc", "des", (F.col("_d") - F.col("depth")).alias("hops"))


def closure_recursive(nodes: DataFrame) -> DataFrame:
    """The same from nodes without numbers, by a recursive common table expression, for trees within the session's limits of
    recursion (by default 100 levels and a million rows)."""
    view = f"nodes_{uuid.uuid4().hex}"
    nodes.select("label", "parent").createOrReplaceTempView(view)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE up(anc, des, hops) AS (
          SELECT label, label, CAST(0 AS BIGINT) FROM {view}
          UNION ALL
          SELECT n.parent, u.des, u.hops + 1 FROM up u JOIN {view} n ON u.anc = n.label WHERE n.parent IS NOT NULL
        ) SELECT anc, des, hops FROM up""")


def leaves_under(tree: DataFrame) -> DataFrame:
    """(label, leaf): the leaves below each node, a leaf below itself. Leaves in preorder are numbers without gaps."""
    place = F.col("first") - F.col("inner_first")
    leaf = tree.filter("is_leaf").select(place.alias("_n"), F.col("label").alias("leaf"))
    return scans.spread(tree.select("label", "first", "last", "inner", "inner_first"), place, F.col("last") - F.col("first") + 1 - F.col("inner"), "_n").join(leaf, "_n").select("label", "leaf")


def last_common_ancestor(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs (a, b) with lca and its lca_dist and lca_depth, and both ends' dist and depth: the parent of the shallowest node
    between the two in preorder. Two lookups a pair, however deep the tree."""
    info = lambda x: tree.select(F.col("label").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("first", "dist", "depth")])
    at = pairs.join(info("a"), "a").join(info("b"), "b")
    low, high = F.least("a_first", "b_first"), F.greatest("a_first", "b_first")
    up = tree.select(F.col("label").alias("parent"), F.col("dist").alias("_up_dist"))
    shallow = tree.join(up, "parent").select("first", F.struct("depth", "parent", F.col("_up_dist").alias("dist")).alias("v"))
    largest = tree.count()
    apart = at.filter("a_first <> b_first").withColumn("_l", low + 1).withColumn("_r", high)
    apart = ranges.answered(apart, "_l", "_r", ranges.table(shallow, "first", F.col("v"), largest), "_best")
    columns = [*pairs.columns, "a_dist", "b_dist", "a_depth", "b_depth"]
    apart = apart.select(*columns, F.col("_best.parent").alias("lca"), F.col("_best.dist").alias("lca_dist"), (F.col("_best.depth") - 1).alias("lca_depth"))
    same = at.filter("a_first = b_first").select(*columns, F.col("a").alias("lca"), F.col("a_dist").alias("lca_dist"), F.col("a_depth").alias("lca_depth"))
    return apart.unionByName(same)


def distances(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs (a, b) with lca, branch-length distance and number of edges between."""
    out = last_common_ancestor(pairs.select("a", "b"), tree)
    return out.select("a", "b", "lca", (F.col("a_dist") + F.col("b_dist") - 2 * F.col("lca_dist")).alias("distance"), (F.col("a_depth") + F.col("b_depth") - 2 * F.col("lca_depth")).alias("hops"))


def violations(nodes: DataFrame) -> DataFrame:
    """(kind, label, n): internal nodes that have not two children, and labels that are blank or not unique."""
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).filter("n <> 2").select(F.lit("not binary").alias("kind"), F.col("parent").cast("string").alias("label"), "n")
    label = F.col("label").cast("string")
    twice = nodes.groupBy("is_leaf", label.alias("label")).agg(F.count("*").alias("n"))
    twice = twice.filter((F.col("n") > 1) | (F.trim("label") == "") | F.col("label").isNull())
    return children.unionByName(twice.select(F.when(F.col("is_leaf"), "leaf label").otherwise("internal label").alias("kind"), "label", "n"))


def input_order(tree: DataFrame) -> DataFrame:
    """(label, pos) of internal nodes by distance from the root, ties in preorder."""
    return scans.ranked(tree.filter("NOT is_leaf").select("label", "dist", "first"), "pos", "dist", "first").select("label", "pos")


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(label, size): internal nodes in the subtree of each internal node, itself included."""
    return tree.filter("NOT is_leaf").select("label", F.col("inner").alias("size"))


def extension_count_log(tree: DataFrame) -> DataFrame:
    """(n, log_count): log of the number of linear extensions, n! / product of subtree sizes. The k-th internal node in preorder
    gives ln(k)."""
    terms = F.log(F.col("inner_first") + 1) - F.log("inner")
    return tree.filter("NOT is_leaf").agg(F.count("*").alias("n"), F.sum(terms).alias("log_count"))


def topology_digest(nodes: DataFrame) -> DataFrame:
    """(labels_digest, topology_digest): hashes of the sorted labels and of the sorted parent>child pairs."""
    label, parent = F.col("label").cast("string"), F.col("parent").cast("string")
    digest = lambda c: F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256), 1, 16)
    return nodes.agg(digest(label).alias("labels_digest"), digest(F.when(parent.isNotNull(), F.concat(parent, F.lit(">"), label))).alias("topology_digest"))


def numeric_ids(tree: DataFrame) -> DataFrame:
    """(label, num): leaves by name from 0, then internal nodes level by level above the leaves, ties by their first leaf. A node's
    level and first leaf are the deepest node and the smallest number of its interval."""
    leaf = scans.ranked(tree.filter("is_leaf").select("label", "first", F.col("label").cast("string").alias("_name")), "num", "_name").select("label", "first", "num")
    size = tree.count()
    inner = tree.filter("NOT is_leaf").select("label", "first", "last", "depth")
    deep = ranges.answered(inner, "first", "last", ranges.table(tree, "first", F.col("depth"), size, "max"), "_deep", "max")
    numbers = tree.select("first").join(leaf.select("first", "num"), "first", "left")
    both = ranges.answered(deep, "first", "last", ranges.table(numbers, "first", F.col("num"), size), "_num")
    order = both.select("label", (F.col("_deep") - F.col("depth")).alias("_level"), "_num", F.col("label").cast("string").alias("_name"))
    up = scans.ranked(order, "_k", "_level", "_num", "_name")
    return leaf.select("label", "num").unionByName(up.select("label", (F.col("_k") + leaf.count()).alias("num")))
