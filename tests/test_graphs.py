"""Graph closures, state spaces, the fold by levels and saturating sums against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from phylochron import catalog
from phylochron.operators import evidence, graphs, kernels, lattice, scans, scoring, trees
from phylochron.plans import fold


def closed(edges):
    found = set(edges)
    while True:
        more = {(a, c) for a, b in found for b2, c in edges if b == b2} - found
        if not more:
            return found
        found |= more


@pytest.mark.parametrize("acyclic", [True, False])
def test_reach_of_random_graphs(spark, acyclic):
    rng = random.Random(5 + acyclic)
    rows = [(g, a, b) for g in (1, 2) for a, b in {(rng.randrange(25), rng.randrange(25)) for _ in range(30)} if not acyclic or a < b]
    more = [(g, a, b) for g, a, b in [(1, 3, 9), (2, 1, 24), (2, 5, 6), (1, 3, 9)]] + ([] if acyclic else [(1, 9, 3)])
    df = lambda x: spark.createDataFrame(x, "g long, src long, dst long")
    known = graphs.reach(df(rows + rows[:3]), "g")
    want = {(g, *p) for g in (1, 2) for p in closed({(a, b) for h, a, b in rows if h == g})}
    got = [tuple(r) for r in known.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in graphs.cycles(known, "g").collect()} == {(g, a) for g, a, b in want if a == b}
    got = [tuple(r) for r in graphs.extended(known, df(more), "g").collect()]
    want = {(g, *p) for g in (1, 2) for p in closed({(a, b) for h, a, b in rows + more if h == g})}
    assert len(got) == len(want) and set(got) == want
    assert graphs.reach(df([])).count() == 0


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graphs.reach(path).count() == 301 * 300 // 2


def test_dense_closures_are_closed_by_blocks(spark, monkeypatch):
    """Several blocks of nodes a graph, with and without cycles; pairs by pairs would be 200 000 000 rows for the path."""
    monkeypatch.setattr(graphs, "SIDE", 64)
    rng = random.Random(8)
    rows = [(g, str(a), str(b)) for g in (1, 2) for a, b in {(rng.randrange(150), rng.randrange(150)) for _ in range(170)} if g == 2 or a < b]
    later = [(1, "3", "200"), (1, "200", "4"), (2, "7", "8"), (3, "1", "2")]
    df = lambda x: spark.createDataFrame(x, "g long, src string, dst string")
    want = lambda x: {(g, *p) for g in (1, 2, 3) for p in closed({(a, b) for h, a, b in x if h == g})}
    known = graphs.closed(df(rows), "g")
    got = [tuple(r) for r in graphs.pairs(*known, "g").collect()]
    assert len(got) == len(set(got)) and set(got) == want(rows)
    for grown in (graphs.pairs(*graphs.more(*known, df(later), "g"), "g"), graphs.extended(graphs.pairs(*known, "g"), df(later), "g")):
        got = [tuple(r) for r in grown.collect()]
        assert len(got) == len(set(got)) and set(got) == want(rows + later)
    monkeypatch.setattr(graphs, "SIDE", 1024)
    path = spark.range(1500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graphs.reach(path).agg(F.count("*"), F.sum(F.col("dst") - F.col("src"))).first()[:] == (1501 * 1500 // 2, sum(d * (1501 - d) for d in range(1, 1501)))


def walked(edges):
    """The pairs (g, src, dst) with a way, from each node by a stack."""
    after = {}
    for g, a, b in edges:
        after.setdefault((g, a), set()).add(b)
    out = set()
    for g, a in after:
        todo = [a]
        while todo:
            for b in after.get((g, todo.pop()), ()):
                if (g, a, b) not in out:
                    out.add((g, a, b))
                    todo.append(b)
    return out


@pytest.mark.parametrize("up", [True, False])
def test_sparse_graphs_are_closed_by_bands(spark, monkeypatch, up):
    """Edges up or down the numbers, circles within a band, a node that leads to many, an edge to itself. Later edges leave the
    bands that lead to none as they are; no block of middle nodes is gone through."""
    monkeypatch.setattr(graphs, "SIDE", 64)
    monkeypatch.setattr(graphs, "BAND", 2, raising=False)
    rng = random.Random(21)
    name = lambda k: f"{k if up else 999 - k:04d}"
    rows = {(g, name(a), name(a + rng.randrange(1, 140))) for g in (1, 2) for a in range(500) for _ in range(2)}
    rows |= {(1, name(a + d), name(a + (d + 1) % 5)) for a in (128, 256 + 60) for d in range(5)} | {(1, name(3), name(k)) for k in range(130, 500, 3)} | {(2, name(9), name(9))}
    later = {(1, name(200), name(450)), (1, name(140), name(250))}  # from the second band
    df = lambda x: spark.createDataFrame(sorted(x), "g long, src string, dst string")
    passed, written = [], []
    monkeypatch.setattr(graphs, "_through", lambda steps, blocks, middle, keys, real=graphs._through: passed.append(1) or real(steps, blocks, middle, keys))
    known = graphs.closed(df(rows), "g")
    got = [tuple(r) for r in graphs.pairs(*known, "g").collect()]
    assert not passed
    assert len(got) == len(set(got)) and set(got) == walked(rows) and len(got) > 50_000
    parts = graphs.Parts
    monkeypatch.setattr(parts, "stored", lambda self, t, part, real=parts.stored: written.append(part) or real(self, t, part))
    grown = graphs.more(*known, df(later), "g")
    got = [tuple(r) for r in graphs.pairs(*grown, "g").collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows | later) and not passed
    assert -1 in written and (written == [-1, 1, 0] or not up)  # kept ones, and those that lead to a later edge
    back = {(2, name(400), name(7)), (3, name(1), name(999))}  # a circle through bands, and a new graph
    got = [tuple(r) for r in graphs.pairs(*graphs.more(*grown, df(back), "g"), "g").collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows | later | back) and passed


def test_graphs_of_many_edges_or_circles_are_closed_by_middle_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SIDE", 64)
    rng = random.Random(22)
    rows = {(1, rng.randrange(150), rng.randrange(150)) for _ in range(190)}
    df = lambda x: spark.createDataFrame(sorted(x), "g long, src long, dst long").drop("g")
    want, later = walked(rows), {(1, 7, 200), (1, 200, 11)}
    for band, sparse in ((1, 16), (8, 0), (8, 16)):
        monkeypatch.setattr(graphs, "BAND", band)
        monkeypatch.setattr(graphs, "SPARSE", sparse)
        known = graphs.closed(df(rows))
        assert ("links" in known[0].columns) == ((band, sparse) == (8, 16))
        assert sorted((1, *r) for r in graphs.pairs(*known).collect()) == sorted(want)
        assert sorted((1, *r) for r in graphs.pairs(*graphs.more(*known, df(later))).collect()) == sorted(walked(rows | later))


def test_components_come_after_those_they_lead_to():
    rng = random.Random(23)
    for n, m in ((1, 0), (60, 40), (60, 70), (60, 200)):
        ways = [[rng.randrange(n) for _ in range(rng.randrange(2 * m // n + 1))] for _ in range(n)]
        reach = {(a, b) for _, a, b in walked({(0, a, b) for a in range(n) for b in ways[a]})}
        found = graphs.components(ways)
        at = {x: k for k, own in enumerate(found) for x in own}
        assert sorted(x for own in found for x in own) == list(range(n))
        assert all((at[a] == at[b]) == (a == b or {(a, b), (b, a)} <= reach) for a in range(n) for b in range(n))
        assert all(at[b] <= at[a] for a in range(n) for b in ways[a])


def test_pairs_of_orders_are_counted_by_blocks(spark, monkeypatch):
    """Labels missing in an order, given twice in one and without a position; several blocks and parts. No join makes pairs."""
    monkeypatch.setattr(scoring, "SIDE", 4)
    rng = random.Random(3)
    rows = [(o, f"n{x}", p) for o in range(5) for p, x in enumerate(rng.sample(range(11), 11 if o else 7))] + [(2, "n3", 1), (3, "n5", None), (4, None, 2)]
    want = {}
    for o, a, p in rows:
        for o2, b, q in rows:
            if o == o2 and a and b and a < b:
                k, n = want.get((a, b), (0, 0))
                want[a, b] = (k + (None not in (p, q) and p < q), n + 1)
    df = spark.createDataFrame(rows, "order_id long, label string, pos long")
    for most in (256, 2):
        monkeypatch.setattr(scoring, "ORDERS", most)
        out = scoring.pair_frequency(df)
        assert {(r.a, r.b): (r.n_before, r.n) for r in out.collect()} == want and out.count() == len(want)
    assert "Join" not in scoring.pair_frequency(df)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert scoring.pair_frequency(df.limit(0)).count() == 0


def test_constant_pairs_are_chosen_where_they_are_counted(spark, monkeypatch):
    """The same pairs as by joins with the tree, which would shuffle them all: labels the tree has not, missing positions, parts."""
    monkeypatch.setattr(scoring, "SIDE", 4)
    rng = random.Random(4)
    tree = trees.numbered(trees.heap_tree(spark, 15)).cache()
    rows = [(o, x, p) for o in range(3) for p, x in enumerate(rng.sample(range(1, 18), 17 if o else 12))] + [(1, 3, None), (2, 5, 1)]
    df = spark.createDataFrame(rows, "order_id long, label long, pos long")
    want = sorted(map(tuple, scoring.constant_pairs(scoring.pair_frequency(df), tree).collect()))
    for most in (256, 2):
        monkeypatch.setattr(scoring, "ORDERS", most)
        assert sorted(map(tuple, scoring.constant_order_pairs(df, tree).collect())) == want and len(want) > 9
    monkeypatch.setattr(scoring, "ORDERS", 256)
    assert scoring.constant_order_pairs(df.limit(0), tree).count() == 0
    (spark.range(9).withColumnRenamed("id", "s_suppkey").selectExpr("s_suppkey", "cast(s_suppkey % 3 as int) AS s_nationkey")).write.mode("overwrite").parquet(path := str(spark.conf.get("spark.sql.warehouse.dir")) + "/few/supplier.parquet")
    plan = catalog.queries()["constant_direction_pairs"](spark, path.rsplit("/", 1)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0]


def test_ranges_are_dealt_out(spark, monkeypatch):
    """One task's rows with long ranges are made by several; all numbers are there once."""
    monkeypatch.setattr(scans, "SPREAD", 1000)
    rows = spark.range(0, 5, 1, 1)
    out = scans.spread(rows, F.col("id"), F.lit(3000), "n", block=100)
    assert sorted((r.id, r.n) for r in out.collect()) == [(k, n) for k in range(5) for n in range(k, k + 3000)]
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 10 and max(tasks) < 3000


def test_state_spaces_broadcast_no_instances(spark):
    nodes = spark.createDataFrame([(1, 1, None), (1, 2, 1)], "instance_id long, label long, parent long")
    given = spark.createDataFrame([(1, 1, 2, 4)], "instance_id long, donor long, receptor long, weight long")
    choices = lattice._choices(lattice.slots(nodes), given)
    states = spark.createDataFrame([(1, 0)], "instance_id long, placed long")
    assert "Broadcast" not in lattice._next(states, choices)._jdf.queryExecution().executedPlan().toString()


def test_in_neighbours(spark):
    df = spark.createDataFrame([(1, 3, 2), (1, 3, 2), (2, 3, 4), (3, 3, 9), (2, 1, 1)], "donor long, receptor long, weight long")
    assert {tuple(r) for r in graphs.in_neighbours(df).collect()} == {(3, 2, 8, 1), (1, 1, 1, 2)}


def test_state_spaces_are_exact(spark):
    rng = random.Random(2)
    shapes = {1: {1: None}, 2: {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3}, 3: {10: None, 20: 10, 30: 20, 40: 10}}
    edges = [(i, *rng.sample(sorted(p), 2), rng.randrange(1, 50) / 7) for i, p in shapes.items() if len(p) > 1 for _ in range(12)]
    nodes = spark.createDataFrame([(i, x, p) for i, t in shapes.items() for x, p in t.items()], "instance_id long, label long, parent long")
    given = spark.createDataFrame([*edges, (2, 4, 4, 9.0), (2, 4, 99, 9.0)], "instance_id long, donor long, receptor long, weight double")
    want = {}
    for i, parent in shapes.items():
        legal = [o for o in itertools.permutations(parent) if all(p is None or o.index(p) < o.index(x) for x, p in parent.items())]
        want[i] = {",".join(map(str, o)): sum(w for j, a, b, w in edges if j == i and o.index(a) > o.index(b)) for o in legal}
    assert len(want[2]) == 80
    for r in lattice.totals(nodes, given, 3.0).collect():
        e = list(want[r.instance_id].values())
        assert r.orders == len(e) and abs(r.best - min(e)) < 1e-9 and r.nodes == len(shapes[r.instance_id])
        assert abs(r.log_mass - math.log(sum(math.exp(-x / 3.0) for x in e))) < 1e-9
    space = lattice.orders(nodes, given, 3.0)
    got = space.collect()
    assert {(r.instance_id, r.state) for r in got} == {(i, s) for i, e in want.items() for s in e} and len(got) == sum(map(len, want.values()))
    for r in got:
        e = want[r.instance_id]
        assert abs(r.energy - e[r.state]) < 1e-9 and abs(r.share - math.exp(-r.energy / 3.0) / sum(math.exp(-x / 3.0) for x in e.values())) < 1e-9
    drawn = [(2, s) for s in sorted(want[2])[:10] for _ in range(3)] + [(2, "no state")] * 2 + [(1, "1")]
    stats = {r.instance_id: r for r in lattice.visited(spark.createDataFrame(drawn, "instance_id long, state string"), space).collect()}
    share = {r.state: r.share for r in got if r.instance_id == 2}
    gap = sum(abs(3 / 32 * (s in sorted(want[2])[:10]) - p) for s, p in share.items()) / 2 + 2 / 32 / 2
    assert (stats[2].samples, stats[2].visited, stats[2].unknown, stats[2].states) == (32, 10, 2, 80) and abs(stats[2].distance - gap) < 1e-9
    assert stats[1].distance < 1e-9 and stats[3].samples == 0 and lattice.totals(nodes.limit(0), given, 1.0).count() == 0


def test_a_chain_passes_the_test_by_total_variation(spark):
    """The self test of the chain: its states are all states of the space, all are seen, and their shares are near the exact ones;
    another temperature is told apart."""
    parent = {"n1": None, "n2": "n1", "n3": "n1", "n4": "n2", "n5": "n2"}
    leaves = {f"{x}{k}": x for x in ("n3", "n4", "n5") for k in "ab"}
    edges = [("n3", "n4", 2.0), ("n5", "n4", 1.0), ("n2", "n3", 1.5)]
    problem = kernels.Problem({"n1": None, "n2": "n1", "n4": "n2", "n5": "n2", "n3": "n1"} | leaves, set(leaves), edges)
    nodes = spark.createDataFrame([(0, x, p) for x, p in parent.items()], "instance_id long, label string, parent string")
    given = spark.createDataFrame([(0, *e) for e in edges], "instance_id long, donor string, receptor string, weight double")
    drawn = [(0, ",".join(o)) for _, o, _ in kernels.chain(problem, kernels.greedy(problem)[0], 40_000, 2.0, 500, 1, random.Random(11))]
    samples = spark.createDataFrame(drawn, "instance_id long, state string")
    right = lattice.visited(samples, lattice.orders(nodes, given, 2.0)).first()
    wrong = lattice.visited(samples, lattice.orders(nodes, given, 0.5)).first()
    assert right.unknown == 0 and right.visited == right.states and right.distance < 0.02 < 0.1 < wrong.distance


def inner_only(n, rng, binary=True):
    """A random tree: nodes (label, parent, is_leaf, length, preorder); every internal node has two children, at random inner."""
    rows, todo, k = [], [(1, None)], 1
    while todo:
        x, p = todo.pop(rng.randrange(len(todo)))
        leaf = k + 2 > n or (x != 1 and rng.random() < 0.3)
        rows.append((x, p, leaf, 1.0, x))
        if not leaf:
            todo += [(k + 1, x), (k + 2, x)]
            k += 2
    return rows


@pytest.mark.parametrize("n", [3, 40, 121])
def test_fold_by_levels_is_the_fold_of_the_kernel(spark, n):
    rng = random.Random(n)
    rows = inner_only(n, rng)
    tree = trees.numbered(spark.createDataFrame(rows, "label long, parent long, is_leaf boolean, length double, preorder long"))
    order = {r.label: r["first"] for r in tree.collect()}
    inner = [r[0] for r in rows if not r[2]]
    edges = {(a, b): rng.random() for a in inner for b in inner}  # between all, so that no two ways cost the same
    by = {r[0]: r for r in rows}
    problem = kernels.Problem({x: by[x][1] for x in sorted(by, key=order.get)}, {x for x in by if by[x][2]}, [(a, b, w) for (a, b), w in edges.items() if a != b])
    given = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()] + [(1, 10_000, 1.0)], "donor long, receptor long, weight double")
    got = [r.label for r in fold.folded(given, tree).orderBy("pos").collect()]
    want = kernels.mixing(problem, random.Random(1))
    assert got == want


def test_fold_of_a_path_has_no_merge(spark):
    n = 2001
    rows = [(k, None if k == 1 else k - 1 if k % 2 == 0 else k - 2, k % 2 == 0 or k == n, 1.0, k) for k in range(1, n + 1)]
    tree = trees.numbered(spark.createDataFrame(rows, "label long, parent long, is_leaf boolean, length double, preorder long"))
    got = fold.folded(spark.createDataFrame([(1, 3, 1.0)], "donor long, receptor long, weight double"), tree)
    assert [r.label for r in got.orderBy("pos").collect()] == list(range(1, n, 2))


def test_saturating_sums(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(3), float(rng.randrange(5)), k * 1_000_003) for k in range(400)] + [(7, 8, 1e11, 5), (7, 8, 1.0, 9), (7, 9, 1e10, 2), (7, 9, 2.0, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "donor long, receptor long, weight double, ingest_seq long")
    for most in (50.0, evidence.SENTINEL):
        want = {}
        for a, b, w, s in sorted(rows, key=lambda r: r[3]):
            total, first = want.get((a, b), (0.0, s))
            want[a, b] = (total + w if total < most else total, first)
        got = {(r.donor, r.receptor): (r.weight, r.first_seq) for r in evidence.saturating_weights(df, most).collect()}
        assert got == want
