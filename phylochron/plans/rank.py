"""The whole analysis: evidence is cleaned, summed and classified by relational plans, ordered by kernels, and the
delivered order is explained by tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import kernels, scoring, trees
from ..shared import folder
from . import orders


@dataclass
class Result:
    """summary: one row's figures. The tables are lazy DataFrames over stored inputs."""

    summary: dict
    order: list
    input_order: list
    classified: DataFrame
    informative: DataFrame
    conflicts: DataFrame
    partial_order: DataFrame
    ranked_newick: str | None = None
    random: DataFrame | None = None
    near_optimal: DataFrame | None = None
    chain: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


class InputError(ValueError):
    """Input that no ranking can be made from."""


def validate(nodes: DataFrame, evidence: DataFrame) -> None:
    """Fails with what is wrong: tree not binary, labels not unique, endpoints unknown, weights not finite."""
    bad = trees.violations(nodes).limit(8).collect()
    if bad:
        raise InputError("tree: " + "; ".join(f"{r['kind']} {r['label']!r} ({r['n']})" for r in bad))
    odd = evidence.filter(F.col("weight").isNull() | (F.col("weight") < 0) | F.isnan("weight") | (F.abs("weight") == float("inf"))).limit(8).collect()
    if odd:
        raise InputError(f"weights that are negative or not finite: {[r['weight'] for r in odd]}")
    lost = ev.unknown_endpoints(evidence, nodes).orderBy("label").limit(8).collect()
    if lost:
        raise InputError(f"endpoints that the tree does not have: {[r['label'] for r in lost]}")


def rank(spark: SparkSession, nodes: DataFrame, evidence: DataFrame, *, distance: float | None = None, threshold: float = 0.0, clade=None, map_ancestors: bool = False, seed: int = 42, iterations: int = 0, temperature: float | None = None, searches: int = 1, near_optimal: int = 10, random_trees: int = 0, chain_iterations: int = 0, chains: int = 1, seconds: float | None = None, chain_temperature: float | None = None, burn_in: int | None = None, thin: int | None = None, checkpoint: str | None = None, checkpoint_every: int = 1000, stop_check: Callable[[], bool] | None = None) -> Result:
    """Ranks the internal nodes of the tree `nodes` (label, parent, is_leaf, length, preorder, depth).

    evidence: (donor, receptor, weight, distance, ingest_seq). threshold: share of the weight to drop, lightest edges
    first. iterations: of each of `searches` independent searches, which end after `seconds` at the latest. random_trees: orders
    of the null distribution. chain_temperature, burn_in, thin: of the chains. checkpoint: a folder for the searches' states,
    stored after every `checkpoint_every` iterations; a stopped run of the same search goes on from there (then no near-optimal orders
    are kept). stop_check: searches end soon after it says yes, with the states stored last (in a folder of their own without
    checkpoint); chains are then left out.
    """
    if not 0 <= threshold <= 1:
        raise InputError("threshold is a share between 0 and 1")
    if min(iterations, random_trees, chain_iterations, near_optimal - 1, burn_in or 0) < 0 or min(searches, chains, checkpoint_every, 1 if thin is None else thin) < 1:
        raise InputError("counts must not be negative; searches, chains, near_optimal, thin and checkpoint_every are at least 1")
    warnings = []
    if clade is None:
        validate(nodes, evidence)
        nodes = trees.numbered(nodes)
    else:
        whole = trees.numbered(nodes)
        if whole.filter(F.col("label") == F.lit(clade)).first() is None:
            raise InputError(f"the tree has no node {clade!r}")
        evidence = ev.prune(evidence, whole, clade, map_ancestors)
        inside = ev.clade(whole, clade).filter("in").select("label")
        nodes = trees.numbered(whole.join(inside, "label", "left_semi").withColumn("parent", F.when(F.col("label") != F.lit(clade), F.col("parent"))))
        validate(nodes, evidence)
    if distance is not None:
        report = ev.distance_report(evidence, distance).first()
        if report["ignored"]:
            warnings.append(f"no evidence is nearer than {distance}; {report['n_unknown']} of {report['n_before']} rows have no distance")
        evidence = ev.distance_filter(evidence, distance)
    edges = ev.edge_weights(evidence)
    classified = ev.classify(edges, nodes)
    soft = ev.threshold(classified.filter("kind <> 'tree_edge'"), threshold) if threshold else classified.filter("kind <> 'tree_edge'")
    classified = soft.unionByName(classified.filter("kind = 'tree_edge'")).cache()
    by_kind = {r["kind"]: (r["n"], r["weight"]) for r in ev.class_summary(classified).collect()}
    total = sum(w for _, w in by_kind.values())
    if not by_kind:
        warnings.append("there is no evidence: every value is 0")
    usable = classified.filter("kind <> 'tree_edge' AND weight <> 0").withColumn("instance_id", F.lit(0).cast("long"))
    problem = kernels.Problem(*orders.tree_of(nodes))
    start, value = _heuristics(spark, usable, nodes, problem, seed)
    method = "greedy" if value["greedy"] <= value["mixing"] else "mixing"
    best, best_value = start[method], value[method]
    near = None
    stopped = False
    if iterations and (checkpoint or stop_check):
        heat = temperature if temperature is not None else max(usable.agg(F.sum("weight")).first()[0] or 0, 1) / 100
        states = orders.resumed(usable, nodes, [seed + k for k in range(searches)], iterations, heat, checkpoint or f"{folder(spark)}/search-{uuid.uuid4().hex}", checkpoint_every, stop_check)
        stopped = stop_check is not None and (states.agg(F.min("done")).first()[0] or 0) < iterations and usable.limit(1).count() > 0
        if stopped:
            warnings.append(f"the search was stopped after {states.agg(F.min('done')).first()[0]} of {iterations} iterations")
        top = states.orderBy("best_value", "seed").first()
        if top is not None and top["best_value"] < best_value:
            best, best_value, method = list(top["best"]), top["best_value"], "search"
    elif iterations:
        near = orders.searched(usable, nodes, [seed + k for k in range(searches)], iterations, temperature, near_optimal, seconds=seconds).cache()
        top = near.filter("rank = 0").orderBy("value", "seed").first()
        if top is not None and top["value"] < best_value:
            best, best_value, method = list(top["labels"]), top["value"], "search"
    ref = [r["label"] for r in trees.input_order(nodes).orderBy("pos").collect()]
    kind = nodes.schema["label"].dataType.simpleString()
    at = lambda o: spark.createDataFrame([(0, x, i) for i, x in enumerate(o)], f"order_id long, label {kind}, pos long")
    info = ev.informative(classified).select("donor", "receptor", "weight", "first_seq")
    open_edges = usable.select("donor", "receptor", "weight")
    partial = scoring.partial_order(open_edges, at(best), at(ref))
    weight = lambda k: float(by_kind.get(k, (0, 0))[1])
    summary = {
        "nodes": len(problem.inner), "edges": sum(n for n, _ in by_kind.values()), "total": float(total),
        "uninformative": sum(weight(k) for k in by_kind if k != "info"), "trivial_conflict": float(ev.trivial_conflict(classified).first()[0] or 0),
        "value_input": scoring.values(usable, at(ref)).agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0], "value_greedy": value["greedy"], "value_mixing": value["mixing"],
        "value": best_value, "method": method, "similarity": kernels.similarity(problem, ref, best),
    } | {f"weight_{k}": weight(k) for k in ("tree_edge", "itself", "desc", "to_leaf", "from_leaf", "anc", "info")}
    out = Result(summary, best, ref, classified, info.drop("first_seq"), scoring.conflicts(open_edges, at(best)).drop("order_id"), partial, near_optimal=near, warnings=warnings)
    out.summary |= {k: v or 0 for k, v in scoring.conflict_ratio(partial).first().asDict().items()}
    if random_trees:
        pos = orders.random_orders(nodes, random_trees, seed)
        sim = scoring.kendall_similarity(pos, at(ref), nodes)
        zero = pos.select("order_id").distinct()
        out.random = zero.join(scoring.values(usable, pos), "order_id", "left").join(sim, "order_id").select("order_id", F.coalesce("value", F.lit(0.0)).alias("value"), "similarity").cache()
        p = scoring.permutation_test(out.random, best_value + 1e-9, summary["similarity"] - 1e-12).first()
        out.summary |= {"random_n": p["n"], "p_value": p["p_value"], "p_similarity": p["p_similarity"]}
    if chain_iterations and not stopped:
        out.chain = orders.chains(usable, nodes, [seed + k for k in range(chains)], chain_iterations, temperature if chain_temperature is None else chain_temperature, burn_in, thin)
    out.ranked_newick = ranked_newick(problem, best)
    return out


def _heuristics(spark: SparkSession, usable: DataFrame, nodes: DataFrame, problem: kernels.Problem, seed: int) -> tuple[dict, dict]:
    """The greedy and the mixing order, made in a task, and their values by joins with the edges."""
    found = orders.heuristics(usable, nodes, seed).drop("instance_id").collect()  # two rows a node
    start = {m: [r["label"] for r in sorted((r for r in found if r["method"] == m), key=lambda r: r["pos"])] for m in ("greedy", "mixing")}
    if not found:  # no edge: every legal order is as good
        start = {m: list(problem.inner) for m in start}
    kind = nodes.schema["label"].dataType.simpleString()
    pos = spark.createDataFrame([(k, x, i) for k, o in enumerate(start.values()) for i, x in enumerate(o)], f"order_id long, label {kind}, pos long")
    value = {r["order_id"]: float(r["value"]) for r in scoring.values(usable, pos).collect()}
    return start, {m: value.get(k, 0.0) for k, m in enumerate(start)}


def ranked_newick(problem: kernels.Problem, order: list) -> str:
    """The tree with the difference of ranks as branch length; leaves are as late as there are ranks."""
    at = {x: i for i, x in enumerate(order)}
    done: dict = {}
    for x in reversed(problem.labels):
        kids = [done.pop(c) for c in problem.children[x]]
        p = problem.parent[x]
        length = "" if p is None else f":{at.get(x, len(order)) - at[p]}"
        done[x] = (f"({','.join(kids)})" if kids else "") + f"{x}{length}"
    return done[problem.root] + ";"
