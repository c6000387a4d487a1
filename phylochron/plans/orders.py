"""Orders for many instances at once. An instance is a group of edges by instance_id (a threshold, a seed, a replicate,
a family); the tree is one, small, and travels with the plan. Each group is one task's work."""

from __future__ import annotations

import hashlib
import random
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels
from ..shared import complete, read_text, write_text

ORDER = "instance_id long, method string, label string, pos long"
SCORE = "instance_id long, method string, value double, similarity double"


def tree_of(nodes: DataFrame) -> tuple[dict, set]:
    """parent by label in preorder, and the leaves. A tree is bounded by its number of species."""
    rows = nodes.select("label", "parent", "is_leaf", "preorder").collect()
    rows.sort(key=lambda r: r["preorder"])
    return {r["label"]: r["parent"] for r in rows}, {r["label"] for r in rows if r["is_leaf"]}


def _problem(tree, group: pa.Table) -> kernels.Problem:
    cols = [group.column(c).to_pylist() for c in ("donor", "receptor", "weight", "first_seq")]
    rows = sorted((r for r in zip(*cols, strict=True) if r[2] != 0), key=lambda r: (-r[2], r[3]))
    return kernels.Problem(tree[0], tree[1], [r[:3] for r in rows])


def heuristics(edges: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """The greedy and the mixing order of every instance: (instance_id, method, label, pos)."""
    tree = tree_of(nodes)
    kind = nodes.schema["label"].dataType.simpleString()

    def run(key, group):
        p = _problem(tree, group)
        found = {"greedy": kernels.greedy(p)[0], "mixing": kernels.mixing(p, random.Random(seed))}
        rows = [(key[0].as_py(), m, x, i) for m, order in found.items() for i, x in enumerate(order)]
        return pa.Table.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(("instance_id", "method", "label", "pos"))}, schema=_schema(group, ("instance_id", "method", "label", "pos")))

    return edges.groupBy("instance_id").applyInArrow(run, f"instance_id long, method string, label {kind}, pos long")


def searched(edges: DataFrame, nodes: DataFrame, seeds: list[int], iterations: int, temperature: float | None = None, keep: int = 10, start_seed: int = 42, seconds: float | None = None) -> DataFrame:
    """Independent searches of every instance, one task for each seed: the best order and the kept near-optimal ones.
    seconds: a search that takes longer ends with what it has.

    (instance_id, seed, rank, value, visits, labels); rank 0 is the best order.
    """
    tree = tree_of(nodes)
    kind = nodes.schema["label"].dataType.simpleString()

    def run(key, group):
        p = _problem(tree, group)
        seed = key[1].as_py()
        start = min((kernels.greedy(p)[0], kernels.mixing(p, random.Random(start_seed))), key=lambda o: kernels.value(p, o))
        heat = temperature if temperature is not None else max(sum(w for *_, w in p.edges), 1) / 100
        pool = kernels.Best(keep)
        end = None if seconds is None else time.monotonic() + seconds
        best, val, _ = kernels.search(p, start, iterations, heat, random.Random(seed), pool, None if end is None else lambda k: k % 64 == 0 and time.monotonic() > end)
        rows = [(0, val, 1, best), *[(k + 1, v, n, o) for k, (o, v, n) in enumerate(pool.rows())]]
        return pa.Table.from_pydict({"instance_id": [key[0].as_py()] * len(rows), "seed": [seed] * len(rows), "rank": [r[0] for r in rows], "value": [float(r[1]) for r in rows], "visits": [r[2] for r in rows], "labels": pa.array([r[3] for r in rows], pa.list_(group.schema.field("donor").type))})

    each = edges.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    return each.groupBy("instance_id", "seed").applyInArrow(run, f"instance_id long, seed long, rank long, value double, visits long, labels array<{kind}>")


def chains(edges: DataFrame, nodes: DataFrame, seeds: list[int], iterations: int, temperature: float | None = None, burn_in: int | None = None, thin: int | None = None) -> DataFrame:
    """Metropolis chains, one task for each instance and seed: (instance_id, chain_id, step, state, energy).

    Samples of a chain whose mixing is not proven; the diagnostics belong beside them.
    """
    tree = tree_of(nodes)
    burn = iterations // 2 if burn_in is None else burn_in
    gap = max(1, iterations // 100) if thin is None else thin

    def run(key, group):
        p = _problem(tree, group)
        seed = key[1].as_py()
        heat = temperature if temperature is not None else max(sum(w for *_, w in p.edges), 1) / 100
        rows = list(kernels.chain(p, kernels.greedy(p)[0], iterations, heat, burn, gap, random.Random(seed)))
        return pa.Table.from_pydict({"instance_id": [key[0].as_py()] * len(rows), "chain_id": [seed] * len(rows), "step": [r[0] for r in rows], "state": [",".join(map(str, r[1])) for r in rows], "energy": [float(r[2]) for r in rows]})

    each = edges.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    return each.groupBy("instance_id", "seed").applyInArrow(run, "instance_id long, chain_id long, step long, state string, energy double")


def random_orders(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """positions of n random legal orders, each from a stream of its own."""
    tree = tree_of(nodes)
    kind = nodes.schema["label"].dataType.simpleString()
    label = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    problem = kernels.Problem(*tree)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                order = kernels.random_order(problem, random.Random(seed * 1_000_003 + k))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(order), pa.int64()), pa.array(order, label), pa.array(range(len(order)), pa.int64())], names=["order_id", "label", "pos"])

    return nodes.sparkSession.range(n).mapInArrow(run, f"order_id long, label {kind}, pos long")


def _schema(group: pa.Table, names) -> pa.Schema:
    kinds = {"instance_id": pa.int64(), "method": pa.string(), "label": group.schema.field("donor").type, "pos": pa.int64()}
    return pa.schema([(n, kinds[n]) for n in names])


STATE = "instance_id long, seed long, done long, labels array<{kind}>, value double, best array<{kind}>, best_value double, random string, complete boolean"


def start_states(edges: DataFrame, nodes: DataFrame, seeds: list[int]) -> DataFrame:
    """A state row for each instance and seed, from the better heuristic order."""
    tree = tree_of(nodes)
    kind = nodes.schema["label"].dataType.simpleString()

    def run(key, group):
        p = _problem(tree, group)
        start = min((kernels.greedy(p)[0], kernels.mixing(p, random.Random(42))), key=lambda o: kernels.value(p, o))
        return _state(group, key[0].as_py(), key[1].as_py(), 0, start, kernels.value(p, start), start, kernels.value(p, start), random.Random(key[1].as_py()), False)

    each = edges.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    return each.groupBy("instance_id", "seed").applyInArrow(run, STATE.format(kind=kind))


def advanced(states: DataFrame, edges: DataFrame, nodes: DataFrame, iterations: int, temperature: float) -> DataFrame:
    """The states after `iterations` more steps each: stored between calls, a search can stop and go on anywhere,
    and gives what one long call gives."""
    tree = tree_of(nodes)
    kind = nodes.schema["label"].dataType.simpleString()
    own = ["instance_id", "seed", "donor", "receptor", "weight", "first_seq"]
    rows = states.select("instance_id", "seed").join(edges, "instance_id").select(*own, *[F.lit(None).cast(t).alias(n) for n, t in _state_types(kind)])
    both = rows.unionByName(states.select("instance_id", "seed", *[n for n, _ in _state_types(kind)]), allowMissingColumns=True)

    def run(key, group):
        at = group.filter(group.column("labels").is_valid())
        p = _problem(tree, group.filter(group.column("weight").is_valid()))
        s = at.to_pylist()[0]
        rng = random.Random()
        rng.setstate(_thawed(s["random"]))
        best, best_value, made, order, value = search_slice(p, s["labels"], iterations, temperature, rng)
        if s["best_value"] <= best_value:
            best, best_value = s["best"], s["best_value"]
        return _state(group, key[0].as_py(), key[1].as_py(), s["done"] + made, order, value, best, best_value, rng, False)

    return both.groupBy("instance_id", "seed").applyInArrow(run, STATE.format(kind=kind))


class CheckpointError(ValueError):
    """Stored states that belong to another search."""


#: Changes when a search would give other states from the same input.
KERNEL = "moves-1"


def identity(edges: DataFrame, nodes: DataFrame, seeds: list[int], temperature: float) -> str:
    """A digest of all that decides a search's states: tree, edges whatever their order, seeds, temperature and kernel."""

    def of(df: DataFrame, *columns) -> str:
        one = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.sum(F.hash(*columns).cast("long"))).first()
        return ",".join(map(str, one))

    tree = of(nodes, "label", "parent", "is_leaf", "preorder")
    given = of(edges, "instance_id", "donor", "receptor", F.col("weight").cast("double"), "first_seq")
    return hashlib.sha256("|".join([tree, given, ",".join(map(str, seeds)), repr(float(temperature)), KERNEL]).encode()).hexdigest()


def resumed(edges: DataFrame, nodes: DataFrame, seeds: list[int], iterations: int, temperature: float, folder: str, every: int, stop: Callable[[], bool] | None = None) -> DataFrame:
    """The states of searches after `iterations` steps, stored in folder after each `every` steps. A call that finds states there,
    of a run that was stopped, goes on from the last ones that were written to their end; a folder that holds another
    search's states (see `identity`) is an error.

    stop: asked between slices and, from a thread, while one runs; once it says yes the running slice is cancelled, and the last states
    stored are the result.
    """
    spark, done, states = edges.sparkSession, 0, None
    own, there = identity(edges, nodes, seeds, temperature), read_text(spark, f"{folder}/identity")
    if there is None:
        write_text(spark, f"{folder}/identity", own)
    elif there.strip() != own:
        raise CheckpointError(f"{folder} holds the states of a search with another tree, evidence, seed or temperature")
    while True:
        path = f"{folder}/{done:012d}"
        if not complete(spark, path):
            if states is not None and stop is not None and stop():
                return states
            made = start_states(edges, nodes, seeds) if states is None else advanced(states, edges, nodes, step, temperature)
            with cancelled_by(spark, stop if states is not None else None) as ended:
                try:
                    made.write.mode("overwrite").parquet(path)
                except Exception:
                    if not ended():
                        raise
                    return states
        states = spark.read.parquet(path)
        if done >= iterations:
            return states
        step = min(every, iterations - done)
        done += step


@contextmanager
def cancelled_by(spark: SparkSession, stop: Callable[[], bool] | None, seconds: float = 0.1):
    """Jobs that this thread starts meanwhile are cancelled as soon as stop() says yes; gives a function that tells whether it did."""
    if stop is None:
        yield lambda: False
        return
    context, tag, over, said = spark.sparkContext, f"stop-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        while not over.wait(seconds):
            if stop():
                said.set()
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield said.is_set
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)


def search_slice(problem: kernels.Problem, start: list, iterations: int, temperature: float, rng: random.Random):
    """A part of a search: the best order and value in it, the steps, and the order and value at its end."""
    last: list = [start, kernels.value(problem, start)]

    class Seen:
        def see(self, order, value):
            last[:] = [list(order), value]

    best, best_value, made = kernels.search(problem, start, iterations, temperature, rng, Seen())
    return best, best_value, made, last[0], last[1]


def _state_types(kind: str) -> list[tuple[str, str]]:
    return [("done", "long"), ("labels", f"array<{kind}>"), ("value", "double"), ("best", f"array<{kind}>"), ("best_value", "double"), ("random", "string"), ("complete", "boolean")]


def _state(group, instance, seed, done, order, value, best, best_value, rng, complete) -> pa.Table:
    import json

    labels = pa.list_(group.schema.field("donor").type)
    return pa.Table.from_pydict({"instance_id": [instance], "seed": [seed], "done": [done], "labels": pa.array([order], labels), "value": [float(value)], "best": pa.array([best], labels), "best_value": [float(best_value)], "random": [json.dumps(rng.getstate())], "complete": [complete]})


def _thawed(text: str):
    import json

    version, numbers, gauss = json.loads(text)
    return version, tuple(numbers), gauss
