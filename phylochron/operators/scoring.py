"""Scores of orders. positions (order_id, label, pos) holds any number of orders; edges are joined to all at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from . import scans, trees


def located(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """edges with both positions in each order; edges that touch a leaf have none and drop out."""
    d = positions.select("order_id", F.col("label").alias("donor"), F.col("pos").alias("donor_pos"))
    r = positions.select("order_id", F.col("label").alias("receptor"), F.col("pos").alias("receptor_pos"))
    return edges.join(d, "donor").join(r, ["order_id", "receptor"])


def values(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(order_id, value): the weight that each order violates."""
    bad = F.when(F.col("donor_pos") > F.col("receptor_pos"), F.col("weight")).otherwise(F.lit(0))
    return located(edges, positions).groupBy("order_id").agg(F.sum(bad).alias("value"))


def conflicts(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges whose donor comes after its receptor."""
    return located(edges, positions).filter("donor_pos > receptor_pos").select("order_id", "donor", "receptor", "weight")


def partial_order(edges: DataFrame, best: DataFrame, reference: DataFrame) -> DataFrame:
    """Edges that the best order keeps (no tree edges among them); green where the reference order violates them, else black.

    best, reference: positions of one order each, with order_id.
    """
    kept = located(edges, best).filter("donor_pos < receptor_pos").select("donor", "receptor", "weight")
    seen = located(kept, reference)
    return seen.select("donor", "receptor", "weight", F.when(F.col("donor_pos") > F.col("receptor_pos"), "green").otherwise("black").alias("flag"))


def conflict_ratio(partial: DataFrame) -> DataFrame:
    """(kept, against_reference, ratio): how much of the kept weight speaks against the reference order."""
    out = partial.agg(F.sum("weight").alias("kept"), F.sum(F.when(F.col("flag") == "green", F.col("weight")).otherwise(F.lit(0))).alias("against_reference"))
    return out.withColumn("ratio", F.round(F.col("against_reference") / F.col("kept"), 6))


def legality(positions: DataFrame, tree: DataFrame) -> DataFrame:
    """(order_id, violated): ancestor pairs that an order turns round; 0 is legal. A node's position opens at its own place in
    preorder and closes behind its subtree; what is open at a node is above it, so the pairs are inversions and are not listed."""
    at = positions.join(tree.select("label", "first", "last"), "label")
    opens = F.struct((2 * F.col("first") + 1).alias("at"), F.lit(1).alias("w"), F.lit(1).alias("q"))
    closes = F.struct((2 * F.col("last") + 2).alias("at"), F.lit(-1).alias("w"), F.lit(0).alias("q"))
    events = at.select("order_id", "pos", F.explode(F.array(opens, closes)).alias("e")).select("order_id", "pos", "e.*")
    return scans.inversions(events, ["order_id"], "at", "pos", _largest(positions), F.col("w"), F.col("q")).withColumnRenamed("n", "violated")


def malformed(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(order_id, problem, n): what keeps an order from being a permutation of the internal nodes: labels that the tree does not
    have, labels or positions given twice, labels that are missing, positions outside 0 to n - 1. An order without any is none."""
    inner = nodes.filter("NOT is_leaf").select("label", F.lit(1).alias("known"))
    size = inner.agg(F.count("*").alias("size"))
    at = positions.join(inner, "label", "left")
    twice = lambda c, name: positions.groupBy("order_id", c).agg((F.count("*") - 1).alias("n")).filter("n > 0").groupBy("order_id").agg(F.sum("n").alias("n")).select("order_id", F.lit(name).alias("problem"), "n")
    per = at.groupBy("order_id").agg(F.count_if(F.col("known").isNull()).alias("unknown label"), F.count_distinct(F.when(F.col("known") == 1, F.col("label"))).alias("have"), F.min("pos").alias("low"), F.max("pos").alias("high")).join(F.broadcast(size))  # one row
    per = per.select("order_id", "unknown label", (F.col("size") - F.col("have")).alias("missing label"), (F.when(F.col("low") < 0, 1).otherwise(0) + F.when(F.col("high") >= F.col("size"), 1).otherwise(0)).cast("long").alias("position out of range"))
    wide = per.select("order_id", F.stack(F.lit(3), *[x for c in per.columns[1:] for x in (F.lit(c), F.col(c))]).alias("problem", "n")).filter("n > 0")
    return wide.unionByName(twice("label", "repeated label")).unionByName(twice("pos", "repeated position"))


def _largest(positions: DataFrame) -> int:
    return positions.agg(F.max("pos")).first()[0] or 0


def kendall_distance(positions: DataFrame, reference: DataFrame) -> DataFrame:
    """(order_id, distance): pairs of labels that an order and the reference (label, pos) put differently, counted as inversions
    of the reference's ranks along the order: n log n rows an order."""
    one = positions.join(reference.select("label", F.col("pos").alias("ref")), "label")
    return scans.inversions(one, ["order_id"], "pos", "ref", _largest(reference)).withColumnRenamed("n", "distance")


def kendall_similarity(positions: DataFrame, reference: DataFrame, tree: DataFrame) -> DataFrame:
    """(order_id, similarity): 1 minus the distance over its maximum, the incomparable pairs of internal nodes: all pairs less as
    many as each node has ancestors, which is its depth."""
    n = tree.filter("NOT is_leaf").agg(F.count("*").alias("n"), F.coalesce(F.sum("depth"), F.lit(0)).alias("comparable")).first()
    most = n["n"] * (n["n"] - 1) // 2 - n["comparable"]
    return kendall_distance(positions, reference).select("order_id", (F.lit(1.0) if most == 0 else (F.lit(most) - F.col("distance")) / F.lit(most)).alias("similarity"))


def hash_orders(orders: DataFrame, tree: DataFrame) -> DataFrame:
    """positions of pseudo-random linear extensions, one for each order_id: labels by the sum of positive coins on the path from
    the root, which grows along every path. A node's coin is added where its interval begins and taken away where it ends, so the
    sums are running ones. There is a row for each order and node, as in the result."""
    inner = tree.filter("NOT is_leaf").select("label", "first", "last")
    toss = orders.select("order_id").crossJoin(inner).withColumn("toss", (1 + F.conv(F.substring(F.md5(F.concat_ws(":", F.col("order_id").cast("string"), F.col("label").cast("string"))), 1, 8), 16, 10).cast("long")))
    begin = F.struct((2 * F.col("first") + 1).alias("at"), F.col("toss").alias("coin"), F.lit(True).alias("own"))
    end = F.struct((2 * F.col("last") + 2).alias("at"), (-F.col("toss")).alias("coin"), F.lit(False).alias("own"))
    events = toss.select("order_id", "label", F.explode(F.array(begin, end)).alias("e")).select("order_id", "label", "e.*")
    key = scans.running(events, ["order_id"], "at", {"key": F.col("coin")}).filter("own").withColumn("key", F.col("key") + F.col("coin"))
    return key.select("order_id", "label", (F.row_number().over(Window.partitionBy("order_id").orderBy("key", "label")) - 1).cast("long").alias("pos"))


def permutation_test(scores: DataFrame, value, similarity) -> DataFrame:
    """(n, p_value, p_similarity): shares of random orders that are as good, with one added; scores: value, similarity."""
    return scores.agg(
        F.count("*").alias("n"),
        ((F.count_if(F.col("value") <= value) + 1) / (F.count("*") + 1)).alias("p_value"),
        ((F.count_if(F.col("similarity") >= similarity) + 1) / (F.count("*") + 1)).alias("p_similarity"),
    )


def move_delta(edges: DataFrame, positions: DataFrame, label, to: int) -> DataFrame:
    """(delta): the change of value when label moves to position `to`; only edges to the labels it crosses count."""
    here = positions.filter(F.col("label") == F.lit(label)).select(F.col("pos").alias("own"))
    crossed = positions.join(here).filter((F.col("label") != F.lit(label)) & F.col("pos").between(F.least("own", F.lit(to)), F.greatest("own", F.lit(to)))).select("label", F.when(F.lit(to) > F.col("own"), 1).otherwise(-1).alias("sign"))
    out = edges.filter(F.col("donor") == F.lit(label)).select(F.col("receptor").alias("label"), "weight")
    into = edges.filter(F.col("receptor") == F.lit(label)).select(F.col("donor").alias("label"), (-F.col("weight")).alias("weight"))
    return out.unionByName(into).join(crossed, "label").agg(F.coalesce(F.sum(F.col("weight") * F.col("sign")), F.lit(0)).alias("delta"))


def near_optimal(scores: DataFrame, k: int) -> DataFrame:
    """(order_id, value, rank): the k best orders; ties by order_id."""
    return scores.orderBy("value", "order_id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("value", "order_id")).cast("long"))


def position_frequency(positions: DataFrame) -> DataFrame:
    """(label, pos, n): in how many orders a label has a position."""
    return positions.groupBy("label", "pos").agg(F.count("*").alias("n"))


#: Labels of a side of a block of pairs, and orders that are counted in it at once.
SIDE, ORDERS = 1024, 256


def pair_frequency(positions: DataFrame) -> DataFrame:
    """(a, b, n_before, n): how often a comes before b, of all orders, for a < b.

    Labels are numbered and cut into blocks, and each pair of blocks is one group that counts its SIDE * SIDE pairs over all orders,
    so a label's row, with its positions in up to ORDERS orders, is copied once a block and no pair of an order is a row: pairs are
    rows only as the result. More than ORDERS orders are counted in parts, which are added up.
    """
    return _paired(positions)


def _paired(positions: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The pairs of pair_frequency; with a tree, those of constant_pairs."""
    known = stored(positions.filter("order_id IS NOT NULL AND label IS NOT NULL").select("order_id", "label", "pos"), "positions")
    names, info = known.select("label").distinct(), [] if tree is None else ["first", "last"]
    if tree is not None:
        names = names.join(tree.select("label", *info), "label")
    labels, orders = scans.ranked(names, "_at", "label"), scans.ranked(known.select("order_id").distinct(), "_o", "order_id")
    blocks, parts = (-(-(of.agg(F.max(c)).first()[0] or 0) // by) for of, c, by in ((labels.withColumn("_at", F.col("_at") + 1), "_at", SIDE), (orders.withColumn("_o", F.col("_o") + 1), "_o", ORDERS)))
    if tree is not None and parts > 1:  # which pairs are constant is known when parts are added up
        return constant_pairs(_paired(known), tree)
    seen = known.join(orders, "order_id").groupBy("label", F.floor(F.col("_o") / ORDERS).alias("_part")).agg(F.collect_list(F.struct(F.pmod("_o", F.lit(ORDERS)).cast("int").alias("o"), "pos")).alias("_seen"))
    rows = seen.join(labels, "label").withColumn("_own", F.floor(F.col("_at") / SIDE)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    cells = rows.select("_part", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_at", "label", *info, F.col("_seen.o").alias("_o"), F.col("_seen.pos").alias("pos"))
    cells = cells.repartition(max(1, min(parts * blocks * (blocks + 1) // 2, MOST_PARTS)), "_part", "_i", "_j")
    kind = positions.schema["label"].dataType.simpleString()
    out = cells.groupBy("_part", "_i", "_j").applyInArrow(_counted(SIDE, tree is not None), f"a {kind}, b {kind}, n_before long, n long")
    return out if parts <= 1 else out.groupBy("a", "b").agg(F.sum("n_before").alias("n_before"), F.sum("n").alias("n"))


#: Tasks among which pairs of blocks are dealt at most: few and small rows make very many pairs.
MOST_PARTS = 4000


def _counted(side: int, constant: bool = False):
    """Counts the pairs of one block of labels with another, order by order; constant: gives only those that all orders put the
    same way and that are not above each other by the intervals first..last of their labels."""

    def run(key, group):
        group = group.combine_chunks()
        place, lists = group.column("_at").to_numpy(), [group.column(c).combine_chunks() for c in ("_o", "pos")]
        row = np.repeat(np.arange(len(place)), lists[0].value_lengths().to_numpy())
        order, pos = (x.flatten() for x in lists)
        by = np.lexsort((place[row], order.to_numpy()))
        row, order, pos = row[by], order.to_numpy()[by], pos.take(pa.array(by))
        at, known, pos = place[row], pos.is_valid().to_numpy(zero_copy_only=False), pos.fill_null(0).to_numpy()
        sides = [np.flatnonzero(at // side == k.as_py()) for k in key[1:]]
        before, n = np.zeros((side, side), np.int64), np.zeros((side, side), np.int64)
        for o in np.unique(order):
            x, y = (of[np.searchsorted(order[of], o) : np.searchsorted(order[of], o, "right")] for of in sides)
            r, c = at[x] % side, at[y] % side
            first = (pos[x][:, None] < pos[y]) & known[x][:, None] & known[y]
            if all(len(k) and k[-1] - k[0] == len(k) - 1 and (np.diff(k) == 1).all() for k in (r, c)):
                spot = slice(r[0], r[-1] + 1), slice(c[0], c[-1] + 1)
                before[spot] += first
                n[spot] += 1
            else:  # labels that an order has not, or has twice
                np.add.at(before, np.ix_(r, c), first)
                np.add.at(n, np.ix_(r, c), 1)
        r, c = np.nonzero(np.triu(n, 1) if key[1] == key[2] else n)
        numbers = []
        for of, k in zip(sides, (r, c), strict=True):
            numbers.append(np.zeros(side, np.int64))
            numbers[-1][at[of] % side] = row[of]
        if constant:
            same = (before[r, c] == 0) | (before[r, c] == n[r, c])
            r, c = r[same], c[same]
            low, high = (group.column(k).fill_null(of).to_numpy() for k, of in (("first", _NEVER.max), ("last", _NEVER.min)))
            a, b = numbers[0][r], numbers[1][c]
            free = ~((low[a] <= low[b]) & (low[b] <= high[a])) & ~((low[b] <= low[a]) & (low[a] <= high[b]))
            r, c = r[free], c[free]
        names = [group.column("label").take(pa.array(of[k])) for of, k in zip(numbers, (r, c), strict=True)]
        return pa.Table.from_arrays([*names, pa.array(before[r, c]), pa.array(n[r, c])], names=["a", "b", "n_before", "n"])

    return run


#: Ends of an interval that holds nothing.
_NEVER = np.iinfo(np.int64)


def constant_order_pairs(positions: DataFrame, tree: DataFrame) -> DataFrame:
    """The constant pairs of all orders. Labels bring their intervals along, so the pairs are chosen where they are counted: no
    other pair leaves its group, and none is shuffled."""
    return _paired(positions, tree)


def constant_pairs(frequency: DataFrame, tree: DataFrame) -> DataFrame:
    """Pairs that all orders put the same way although the tree leaves them open."""
    info = lambda x: tree.select(F.col("label").alias(x), F.col("first").alias(f"_{x}"), F.col("last").alias(f"_{x}_last"))
    out = frequency.filter("n_before = 0 OR n_before = n").join(info("a"), "a").join(info("b"), "b")
    open_pair = ~trees.is_above(F.col("_a"), F.col("_a_last"), F.col("_b")) & ~trees.is_above(F.col("_b"), F.col("_b_last"), F.col("_a"))
    return out.filter(open_pair).select(*frequency.columns)
