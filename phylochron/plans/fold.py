"""The bottom-up merge of a tree's orders, level by level as grouped tasks: a large tree is merged by as many tasks as it has nodes
of a level, not by one.

Only nodes with two internal children need a merge; the others are put behind their child's order. A merge needs the evidence
between its two sides, which is the evidence whose endpoints have the node as last common ancestor, so every edge goes to one
merge. A node's level is the most merges on a way down from it. A merge itself is one table of its two sides' sizes.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels, ranges, scans, trees
from ..shared import Steps


def merges(tree: DataFrame) -> DataFrame:
    """(label, up, side, level, depth): for each internal node the nearest node above it that merges (null: none), on which side
    it lies there (0 first child, 1 second), and its own level if it merges, else null; tree: numbered."""
    inner = tree.filter("NOT is_leaf").select("label", "parent", "first", "last", "depth")
    kids = inner.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("_kids"), F.max("first").alias("second"))
    at = inner.join(kids, "label", "left").withColumn("_merges", F.coalesce(F.col("_kids") == 2, F.lit(False)))
    # merges on the way from the root to each node: opened at its interval's start, closed behind its end
    one = F.col("_merges").cast("long")
    events = at.select("label", "_merges", "first", "last", F.explode(F.array(F.struct((2 * F.col("first") + 1).alias("at"), one.alias("w"), F.lit(True).alias("own")), F.struct((2 * F.col("last") + 2).alias("at"), (-one).alias("w"), F.lit(False).alias("own")))).alias("e")).select("label", "_merges", "e.*")
    above = scans.running(events, [], "at", {"above": F.col("w")}).filter("own").select("label", F.col("above").cast("long").alias("above"))
    at = at.join(above, "label")
    # merges of one count are in intervals that do not meet: the nearest one above is the last that begins before
    begin = at.filter("_merges").select((F.col("above") + 1).alias("_at"), F.struct("first", "label", "second").alias("m"), (2 * F.col("first")).alias("at"), F.lit(None).cast(tree.schema["label"].dataType).alias("of"))
    asked = at.filter("above > 0").select(F.col("above").alias("_at"), F.lit(None).cast(begin.schema["m"].dataType).alias("m"), (2 * F.col("first") - 1).alias("at"), F.col("label").alias("of"))
    near = scans.running(begin.unionByName(asked), ["_at"], "at", {"near": F.col("m")}, "max").filter("of IS NOT NULL").select(F.col("of").alias("label"), "near")
    deep = tree.select("first").join(at.select("first", (F.col("above") + one).alias("_c")), "first", "left")
    level = ranges.answered(at.filter("_merges"), "first", "last", ranges.table(deep, "first", F.col("_c"), tree.count(), "max"), "_most", "max").select("label", (F.col("_most") - F.col("above")).alias("level"))
    out = at.join(near, "label", "left").join(level, "label", "left")
    return out.select("label", F.col("near.label").alias("up"), F.when(F.col("near").isNotNull(), (F.col("first") >= F.col("near.second")).cast("int")).alias("side"), "level", "depth")


def folded(edges: DataFrame, tree: DataFrame, seed: int = 42) -> DataFrame:
    """(label, pos): the merged order of a numbered tree's internal nodes, earliest first. edges (donor, receptor, weight). Merges of
    equal cost are chosen by a coin of the seed and the node."""
    label = tree.schema["label"].dataType
    kind = label.simpleString()
    with Steps(tree.sparkSession, "fold") as steps:
        plan = steps.stored(merges(tree), "plan")
        inner = plan.select(F.col("label"))
        pairs = edges.groupBy(F.col("donor").alias("a"), F.col("receptor").alias("b")).agg(F.sum("weight").cast("double").alias("w")).filter("a <> b AND w <> 0")
        for side in ("a", "b"):
            pairs = pairs.join(inner.withColumnRenamed("label", side), side, "left_semi")
        pairs = steps.stored(pairs, "pairs")
        between = steps.stored(trees.last_common_ancestor(pairs, tree).filter("lca <> a AND lca <> b").select(F.col("lca").alias("node"), F.lit(-1).alias("side"), F.lit(0).cast("long").alias("pos"), F.col("a").alias("label"), F.col("b").alias("other"), "w"), "between")
        # a node that does not merge waits, behind what is merged below it, for the merge above; deeper ones first
        chain = plan.filter("level IS NULL").select(F.col("up").alias("node"), "side", (F.lit(1 << 40) - F.col("depth")).alias("pos"), "label")
        waiting = steps.stored(chain, "waiting")
        for level in range(1, (plan.agg(F.max("level")).first()[0] or 0) + 1):
            now = plan.filter(F.col("level") == level).select(F.col("label").alias("node"))
            rows = waiting.join(now, "node", "left_semi").select("node", "side", "pos", "label", F.lit(None).cast(label).alias("other"), F.lit(None).cast("double").alias("w"))
            rows = rows.unionByName(between.join(now, "node", "left_semi"))
            made = rows.groupBy("node").applyInArrow(_merger(seed), f"node {kind}, pos long, label {kind}")
            up = plan.select(F.col("label").alias("node"), F.col("up").alias("_up"), F.col("side"))
            made = made.join(up, "node").select(F.col("_up").alias("node"), "side", "pos", "label")
            waiting = steps.stored(waiting.join(now, "node", "left_anti").unionByName(made), "waiting")
        whole = scans.ranked(waiting.filter("node IS NULL"), "_k", F.col("pos").desc())
        return steps.result(whole.select("label", F.col("_k").alias("pos")), "folded")


def _merger(seed: int):
    """Merges the two sides of a node: both are latest first, as is the result, with the node itself at its end."""

    def run(key, group):
        node, kind = key[0].as_py(), group.schema.field("label").type
        side = group.column("side").to_numpy()
        order = [group.filter(pa.array(side == k)).sort_by([("pos", "ascending"), ("label", "ascending")]).column("label").combine_chunks() for k in (0, 1)]
        edges = group.filter(pa.array(side == -1))
        place = [[pc.index_in(edges.column(c), value_set=o).fill_null(-1).to_numpy() for o in order] for c in ("label", "other")]
        w, gives = edges.column("w").to_numpy(), []
        for k in (0, 1):
            own = place[0][k] >= 0
            gives.append((place[0][k][own], place[1][1 - k][own], w[own]))
        first = kernels.interleaved_lean(len(order[0]), len(order[1]), *gives, random.Random(f"{seed}:{node}"))
        row = np.where(first, np.cumsum(first) - 1, len(order[0]) + np.cumsum(~first) - 1)
        out = pa.concat_arrays([pa.concat_arrays(order).take(pa.array(row)), pa.array([node], kind)])
        return pa.Table.from_arrays([pa.array([node], kind).take(pa.array(np.zeros(len(out), np.int64))), pa.array(np.arange(len(out))), out], names=["node", "pos", "label"])

    return run
