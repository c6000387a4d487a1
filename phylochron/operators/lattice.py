"""The state space of small instances, exactly: legal orders are the ways up the lattice of down-sets of a tree.

A state is the set of nodes placed so far, as bits of a long. Level by level, each set is joined with the nodes that may come
next; sets that meet are put together, so an instance has as many rows as down-sets, not as orders. All instances of a table
go through the same joins, which are shuffled: tables have rows for each instance, and none is sent through the driver. An instance has at most 62 nodes; how many sets it has depends on how wide its tree is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Steps


def _choices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(instance_id, label, bit, need, out): each node's bit, its parent's bit (0 at the root), and what it gives to others, as
    bits and weights: 62 at most."""
    slot = nodes.select("instance_id", F.col("label").alias("receptor"), F.col("slot").alias("_slot"))
    given = edges.filter("donor <> receptor").join(slot.hint("merge"), ["instance_id", "receptor"]).groupBy("instance_id", F.col("donor").alias("label"), "_slot").agg(F.sum("weight").cast("double").alias("_w"))
    out = given.groupBy("instance_id", "label").agg(F.array_sort(F.collect_list(F.struct(F.expr("shiftleft(1L, _slot)").alias("bit"), F.col("_w").alias("w")))).alias("out"))
    parent = nodes.select("instance_id", F.col("label").alias("parent"), F.expr("shiftleft(1L, slot)").alias("need"))
    own = nodes.select("instance_id", "label", "parent", F.expr("shiftleft(1L, slot)").alias("bit"))
    both = own.join(parent.hint("merge"), ["instance_id", "parent"], "left").join(out.hint("merge"), ["instance_id", "label"], "left")
    return both.select("instance_id", "label", "bit", F.coalesce("need", F.lit(0)).alias("need"), F.coalesce("out", F.expr("array()").cast("array<struct<bit:bigint,w:double>>")).alias("out"))


def _next(states: DataFrame, choices: DataFrame) -> DataFrame:
    """Each state with each node that may come next; cost: what the node gives to nodes that are placed, which it violates."""
    may = (F.col("placed").bitwiseAND(F.col("bit")) == 0) & (F.col("placed").bitwiseAND(F.col("need")) == F.col("need"))
    cost = F.aggregate("out", F.lit(0.0), lambda a, x: a + F.when(F.col("placed").bitwiseAND(x["bit"]) != 0, x["w"]).otherwise(F.lit(0.0)))
    return states.join(choices.hint("merge"), "instance_id").filter(may).withColumn("cost", cost).withColumn("set", F.col("placed").bitwiseOR(F.col("bit")))


def slots(nodes: DataFrame, *keys: str) -> DataFrame:
    """nodes (instance_id, label, parent) with slot, their number by label within the instance; fails above 62."""
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy("instance_id").orderBy("label")) - 1
    return nodes.withColumn("slot", slot).withColumn("slot", F.when(F.col("slot") < 62, F.col("slot")).otherwise(F.raise_error(F.lit("an instance of a state space has 62 nodes at most")).cast("int")))


def totals(nodes: DataFrame, edges: DataFrame, temperature: float) -> DataFrame:
    """(instance_id, nodes, orders, best, log_mass): how many legal orders each instance has, the least weight that any of them
    violates, and the log of the sum of exp(-violated / temperature) over all of them.

    nodes (instance_id, label, parent): internal nodes, parent null at the root; edges (instance_id, donor, receptor, weight).
    """
    nodes = slots(nodes)
    with Steps(nodes.sparkSession, "lattice") as steps:
        choices = steps.stored(_choices(nodes, edges), "choices")
        size = choices.groupBy("instance_id").agg(F.count("*").alias("nodes"))
        states = size.select("instance_id", F.lit(0).cast("long").alias("placed"), F.lit(1).cast("decimal(38,0)").alias("orders"), F.lit(0.0).alias("best"), F.lit(1.0).alias("mass"))
        done = None
        for _ in range(size.agg(F.max("nodes")).first()[0] or 0):
            # A set has a way in from each of its last nodes, so a list of its ways is short. Masses are relative to the best.
            way = F.struct((F.col("best") + F.col("cost")).alias("best"), "mass")
            ways = _next(states, choices).groupBy("instance_id", "set").agg(F.sum("orders").cast("decimal(38,0)").alias("orders"), F.array_sort(F.collect_list(way)).alias("ways"))
            low = F.col("ways")[0]["best"]
            mass = F.aggregate("ways", F.lit(0.0), lambda a, x: a + x["mass"] * F.exp((low - x["best"]) / temperature))
            states = steps.stored(ways.select("instance_id", F.col("set").alias("placed"), "orders", low.alias("best"), mass.alias("mass")), "states")
            full = states.withColumn("_n", F.bit_count("placed").cast("long")).join(size.hint("merge"), "instance_id").filter("_n = nodes")
            full = full.select("instance_id", "nodes", "orders", "best", (F.log("mass") - F.col("best") / temperature).alias("log_mass"))
            done = full if done is None else done.unionByName(full)
        if done is None:
            done = states.select("instance_id", F.lit(0).cast("long").alias("nodes"), "orders", "best", F.lit(0.0).alias("log_mass"))
        return steps.result(done, "lattice")


def orders(nodes: DataFrame, edges: DataFrame, temperature: float) -> DataFrame:
    """(instance_id, state, energy, share): every legal order of each instance as labels with commas, the weight that it violates,
    and its share of the Boltzmann distribution. As many rows as there are orders; `totals` tells before how many."""
    nodes = slots(nodes)
    with Steps(nodes.sparkSession, "orders") as steps:
        choices = steps.stored(_choices(nodes, edges), "choices")
        size = choices.groupBy("instance_id").agg(F.count("*").alias("nodes"))
        states = size.select("instance_id", F.lit(0).cast("long").alias("placed"), F.lit("").alias("state"), F.lit(0.0).alias("energy"))
        done = None
        for k in range(size.agg(F.max("nodes")).first()[0] or 0):
            state = F.concat(F.col("state"), F.lit("," if k else ""), F.col("label").cast("string"))
            states = _next(states, choices).select("instance_id", F.col("set").alias("placed"), state.alias("state"), (F.col("energy") + F.col("cost")).alias("energy"))
            states = steps.stored(states, "states")
            full = states.join(size.hint("merge"), "instance_id").filter(F.bit_count("placed") == F.col("nodes")).select("instance_id", "state", "energy")
            done = full if done is None else done.unionByName(full)
        every = steps.stored(states.select("instance_id", "state", "energy") if done is None else done, "orders")
        low = every.groupBy("instance_id").agg(F.min("energy").alias("_low"))
        weight = F.exp((F.col("_low") - F.col("energy")) / temperature)
        whole = every.join(low.hint("merge"), "instance_id").groupBy("instance_id").agg(F.sum(weight).alias("_whole"), F.first("_low").alias("_low"))
        return steps.result(every.join(whole.hint("merge"), "instance_id").select("instance_id", "state", "energy", (weight / F.col("_whole")).alias("share")), "orders")


def visited(samples: DataFrame, space: DataFrame) -> DataFrame:
    """(instance_id, samples, visited, unknown, states, distance): what samples (instance_id, state) saw of the state space: how
    many different states of it, samples that are no state of it, and the total variation distance of the sampled shares from
    the exact ones (0 if equal, 1 if disjoint)."""
    seen = samples.groupBy("instance_id", "state").agg(F.count("*").alias("seen"))
    n = seen.groupBy("instance_id").agg(F.sum("seen").alias("samples"))
    both = space.join(seen, ["instance_id", "state"], "full").join(n, "instance_id", "left")
    gap = F.abs(F.coalesce("seen", F.lit(0)) / F.col("samples") - F.coalesce("share", F.lit(0.0)))
    return both.groupBy("instance_id").agg(
        F.coalesce(F.first("samples"), F.lit(0)).alias("samples"),
        F.count_if(F.col("seen").isNotNull() & F.col("share").isNotNull()).alias("visited"),
        F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("seen"))), F.lit(0)).alias("unknown"),
        F.count("share").alias("states"),
        (F.sum(gap) / 2).alias("distance"),
    )
