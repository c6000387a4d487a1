"""Intervals, range minima, inversions and what is made of them, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from phylochron.operators import evidence, ranges, scans, scoring, trees
from phylochron.sources import synthetic

NODES = "label long, parent long, is_leaf boolean, length double, preorder long"


def random_tree(n, rng, deep=False):
    """(label, parent, is_leaf, length, preorder) of a random tree in shuffled rows; deep: mostly one path."""
    parent = {0: None}
    for k in range(1, n):
        parent[k] = k - 1 if deep and rng.random() < 0.97 else rng.randrange(k)
    kids = {k: [] for k in parent}
    for k, p in parent.items():
        if p is not None:
            kids[p].append(k)
    rows = [(k, p, not kids[k], rng.choice([None, 0.25, 0.1, 3.0]), 7 * k) for k, p in parent.items()]
    rng.shuffle(rows)
    return rows, parent, kids


def walked(rows, parent, kids):
    """first, last, inner_first, inner, depth, dist by label, by a walk with a stack."""
    leaf, length = {r[0]: r[2] for r in rows}, {r[0]: r[3] or 0 for r in rows}
    out, count, inner, stack = {}, 0, 0, [(0, False)]
    while stack:
        x, done = stack.pop()
        if done:
            out[x][1], out[x][3] = count - 1, inner - out[x][2]
            continue
        p = parent[x]
        depth, dist = (out[p][4] + 1, out[p][5] + length[x]) if p is not None else (0, 0)
        out[x] = [count, None, inner, None, depth, dist]
        count, inner = count + 1, inner + (not leaf[x])
        stack.append((x, True))
        stack += [(c, False) for c in sorted(kids[x], reverse=True)]
    return out


def path(x, parent):
    while x is not None:
        yield x
        x = parent[x]


@pytest.mark.parametrize(("n", "deep"), [(1, False), (2, False), (200, False), (500, True)])
def test_numbers_of_random_trees(spark, n, deep):
    rng = random.Random(n)
    rows, parent, kids = random_tree(n, rng, deep)
    tree = trees.numbered(spark.createDataFrame(rows, NODES))
    want = walked(rows, parent, kids)
    got = {r.label: r for r in tree.collect()}
    assert set(got) == set(want)
    for x, w in want.items():
        g = got[x]
        assert [g["first"], g["last"], g["inner_first"], g["inner"], g["depth"]] == w[:5] and abs(g["dist"] - w[5]) < 1e-9
    ids = sorted(want)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(150)] + [(0, 0)]
    asked = spark.createDataFrame(pairs, "a long, b long").distinct()
    answers = trees.distances(asked, tree).collect()
    assert {(r.a, r.b) for r in answers} == set(pairs)
    for r in answers:
        above = set(path(r.a, parent))
        lca = next(x for x in path(r.b, parent) if x in above)
        assert r.lca == lca and r.hops == want[r.a][4] + want[r.b][4] - 2 * want[lca][4]
        assert abs(r.distance - (want[r.a][5] + want[r.b][5] - 2 * want[lca][5])) < 1e-9
    pairs = {(r.anc, r.des): r.hops for r in trees.closure(tree).collect()}
    assert pairs == {(a, x): k for x in ids for k, a in enumerate(path(x, parent))}
    below = {(r.label, r.leaf) for r in trees.leaves_under(tree).collect()}
    assert below == {(a, x) for x in ids if not kids[x] for a in path(x, parent)}
    inner = [x for x in ids if kids[x]]
    open_pairs = {(r.donor, r.receptor) for r in synthetic.incomparable_pairs(tree).collect()}
    assert open_pairs == {(a, b) for a in inner for b in inner if a not in set(path(b, parent)) and b not in set(path(a, parent))}


@pytest.mark.parametrize("deep", [False, True])
def test_open_pairs_are_made_from_blocks(spark, monkeypatch, deep):
    """Several blocks, the last one not full. Pairs are made above every join and shuffle, so none is shuffled."""
    rng = random.Random(12 + deep)
    rows, parent, kids = random_tree(150, rng, deep)
    nodes = spark.createDataFrame([(f"n{k}", None if p is None else f"n{p}", leaf, 1.0, x) for k, p, leaf, _, x in rows], NODES.replace("label long, parent long", "label string, parent string"))
    tree = trees.numbered(nodes)
    above, inner = {x: set(path(x, parent)) for x in parent}, [x for x in parent if kids[x]]
    want = sorted((f"n{a}", f"n{b}") for a in inner for b in inner if a not in above[b] and b not in above[a])
    for side in (7, 4096):
        monkeypatch.setattr(synthetic, "SIDE", side, raising=False)
        out = synthetic.incomparable_pairs(tree)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 9
    made, _, below = out._jdf.queryExecution().optimizedPlan().toString().partition("Repartition")
    assert "explode(slice" in made and "Join" not in made and "slice" not in below
    assert synthetic.incomparable_pairs(tree.filter("is_leaf")).count() == 0


def test_path_of_fifty_thousand_levels(spark):
    deep = 50_000
    k = F.col("id")
    nodes = spark.range(deep + 1).select(k.alias("label"), F.when(k > 0, k - 1).alias("parent"), (k == deep).alias("is_leaf"), F.lit(1).cast("long").alias("length"))
    tree = trees.numbered(nodes)
    assert tree.filter(f"first <> label OR last <> {deep} OR depth <> label OR dist <> label OR inner <> {deep} - label").count() == 0 and tree.count() == deep + 1
    edges = spark.createDataFrame([(7, 49_000, 1), (49_000, 7, 1), (3, 4, 1), (9, 9, 1), (60_000, 1, 1)], "donor long, receptor long, weight long")
    kinds = {(r.donor, r.receptor): r.kind for r in evidence.classify(edges, tree).collect()}
    assert kinds == {(7, 49_000): "desc", (49_000, 7): "anc", (3, 4): "tree_edge", (9, 9): "itself", (60_000, 1): "info"}
    kept = evidence.prune(edges, tree, 48_000)
    assert kept.count() == 0 and evidence.prune(edges, tree, 5).count() == 3 and evidence.prune(edges, tree, 70_000).count() == 0
    got = trees.distances(spark.createDataFrame([(40_000, 20_000), (0, 50_000)], "a long, b long"), tree).collect()
    assert {(r.a, r.lca, r.hops) for r in got} == {(40_000, 20_000, 20_000), (0, 0, 50_000)}


def test_running_values_in_blocks(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.randrange(-9, 9)) for g in (1, 2) for k in range(50)] + [(3, 0, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, at long, x long")
    for block in (4, 4096):
        for how, plain, empty in (("sum", sum, 0), ("min", min, None), ("max", max, None)):
            got = scans.running(df, ["g"], "at", {"y": F.col("x")}, how, block=block).collect()
            assert len(got) == len(rows)
            for r in got:
                before = [x for g, k, x in rows if g == r.g and k < r.at]
                assert r.y == (plain(before) if before else empty)


def test_ranges(spark):
    rng = random.Random(8)
    x = [rng.randrange(100) for _ in range(77)]
    values = spark.createDataFrame(list(enumerate(x)), "at long, x long")
    asked = spark.createDataFrame([(i, j) for i in range(77) for j in range(i, 77)], "l long, r long")
    for how, plain in (("min", min), ("max", max)):
        got = ranges.answered(asked, "l", "r", ranges.table(values, "at", F.col("x"), 76, how), "best", how).collect()
        assert len(got) == 77 * 78 // 2 and all(r.best == plain(x[r.l : r.r + 1]) for r in got)


def test_ranks_and_spread(spark):
    rows = [(k * 7919 % 1000, "x") for k in range(1000)]
    df = spark.createDataFrame(rows, "v long, s string").repartition(4)
    assert sorted((r.v, r.k) for r in scans.ranked(df, "k", F.col("v").desc()).collect()) == [(v, 999 - v) for v in range(1000)]
    got = scans.spread(spark.createDataFrame([(1, 5, 9), (2, 0, 0), (3, 2, 1)], "id long, s long, c long"), F.col("s"), F.col("c"), "n", block=4)
    assert sorted((r.id, r.n) for r in got.collect()) == [(1, n) for n in range(5, 14)] + [(3, 2)]


def inversions(order):
    """By merging."""
    if len(order) < 2:
        return 0, order
    m = len(order) // 2
    (a, left), (b, right) = inversions(order[:m]), inversions(order[m:])
    out, i, n = [], 0, a + b
    for y in right:
        while i < len(left) and left[i] < y:
            out.append(left[i])
            i += 1
        n += len(left) - i
        out.append(y)
    return n, out + left[i:]


def test_kendall_distance_of_many_orders(spark):
    """1000 orders of 3000 labels: 4.5 million pairs each, none of which is made."""
    n, a = 3000, 1 + 2 * F.col("order_id") % 2999
    ids = spark.range(1000).select(F.col("id").alias("order_id"))
    labels = spark.range(n).select(F.col("id").alias("label"))
    # n is prime to a: a permutation of 0..2998, and the last label stays last
    pos = F.when(F.col("label") == n - 1, F.lit(n - 1)).otherwise((F.col("label") * a + F.col("order_id")) % (n - 1))
    orders = ids.crossJoin(labels).select("order_id", "label", pos.cast("long").alias("pos"))
    got = {r.order_id: r.distance for r in scoring.kendall_distance(orders, labels.select("label", F.col("label").alias("pos"))).collect()}
    assert len(got) == 1000
    for k in (0, 1, 7, 400, 999):
        step = 1 + 2 * k % 2999
        at = [(x * step + k) % (n - 1) for x in range(n - 1)] + [n - 1]
        assert sorted(at) == list(range(n))
        order = sorted(range(n), key=at.__getitem__)
        assert got[k] == inversions(order)[0]


def test_turned_ancestor_pairs(spark):
    rng = random.Random(12)
    rows, parent, _ = random_tree(120, rng)
    tree = trees.numbered(spark.createDataFrame(rows, NODES))
    orders = {k: rng.sample(range(120), 120) for k in range(4)} | {9: list(range(120))}
    pos = spark.createDataFrame([(k, x, i) for k, o in orders.items() for i, x in enumerate(o)], "order_id long, label long, pos long")
    got = {r.order_id: r.violated for r in scoring.legality(pos, tree).collect()}
    for k, o in orders.items():
        at = {x: i for i, x in enumerate(o)}
        assert got[k] == sum(at[a] > at[x] for x in range(120) for a in path(x, parent))
    assert got[9] == 0 and got[0] > 0
