import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phylochron.operators import kernels as k
from phylochron.sources import newick

TREE = "(((a,b)n4,(c,d)n5)n2,((e,f)n6,(g,h)n7)n3)n1;"


def make(edges=()):
    return newick.problem(newick.parse(TREE), sorted(edges, key=lambda e: -e[2]))


def test_counts_of_legal_orders():
    p = make()
    assert k.extension_count(p) == 80 == sum(1 for _ in k.extensions(p))
    assert sum(1 for _ in k.extensions(p, 7)) == 7


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(1, 7), st.integers(1, 9)), max_size=15))
def test_orders_are_legal_and_never_beat_the_best(raw):
    pairs = {}
    for a, b, w in raw:
        if a != b:
            pairs[f"n{a}", f"n{b}"] = pairs.get((f"n{a}", f"n{b}"), 0) + w
    p = make([(a, b, float(w)) for (a, b), w in pairs.items()])
    legal = {tuple(o) for o in k.extensions(p)}
    best = min(k.value(p, list(o)) for o in legal)
    for order in (k.greedy(p)[0], k.mixing(p, random.Random(1)), k.random_order(p, random.Random(2)), k.search(p, k.greedy(p)[0], 200, 1.0, random.Random(3))[0]):
        assert tuple(order) in legal
        assert k.value(p, order) >= best - 1e-9
    for _, order, energy in k.chain(p, k.greedy(p)[0], 50, 2.0, 5, 5, random.Random(4)):
        assert tuple(order) in legal and abs(k.value(p, order) - energy) < 1e-9


def test_moves_change_the_value_by_their_gain():
    rng = random.Random(5)
    p = make([(f"n{a}", f"n{b}", rng.random()) for a in range(1, 8) for b in range(1, 8) if a != b])
    walk = k.Walk(p, k.greedy(p)[0])
    for _ in range(300):
        i, j = k.pair(7, rng)
        gain = walk.move_gain(i, j) if rng.random() < 0.5 else None
        if gain is not None:
            walk.move(i, j, gain)
        elif (gain := walk.swap_gain(i, j)) is not None:
            walk.swap(i, j, gain)
        assert abs(walk.value - walk.exact()) < 1e-9


def test_reach_is_the_transitive_closure():
    rng = random.Random(6)
    reach, edges = k.Reach(12), set()
    for _ in range(40):
        u, v = rng.randrange(12), rng.randrange(12)
        reach.add(u, v)
        edges.add((u, v))
        want = {(i, i) for i in range(12)} | edges
        for m, i, j in itertools.product(range(12), repeat=3):
            if (i, m) in want and (m, j) in want:
                want.add((i, j))
        assert all(reach.has(i, j) == ((i, j) in want) for i in range(12) for j in range(12))


def test_kendall():
    a = list("abcdef")
    rng = random.Random(7)
    for _ in range(20):
        b = rng.sample(a, 6)
        at = {x: i for i, x in enumerate(b)}
        assert k.kendall(a, b) == sum(at[x] > at[y] for x, y in itertools.combinations(a, 2))
    p = make()
    orders = list(k.extensions(p))
    assert max(k.kendall(x, y) for x, y in itertools.combinations(orders, 2)) == k.most_kendall(p)


def test_best_keeps_k_and_drops_the_oldest_of_the_worst():
    b = k.Best(2)
    for o, v in (("x", 3.0), ("y", 3.0), ("x", 3.0), ("z", 1.0)):
        b.see((o,), v)
    assert b.rows() == [(["z"], 1.0, 1), (["y"], 3.0, 1)]
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            k.Best(bad)


def test_search_stops_when_told():
    p = make([("n6", "n4", 1.0)])
    assert k.search(p, k.greedy(p)[0], 1000, 1.0, random.Random(1), stop=lambda i: i == 51)[2] == 51


@pytest.mark.parametrize("whole", [True, False])
def test_lean_interleaving_draws_the_same(whole):
    """Rows made at once and made again give what the whole table gives, ties by the same coins."""
    rng = np.random.default_rng(4)
    for n, m in ((0, 3), (1, 0), (1, 7), (30, 21), (90, 130)):
        give = [(rng.random(s) < 0.1) * rng.integers(1, 4, s) * (1.0 if whole else 0.1) for s in ((n, m), (m, n))]
        want = k.interleaved(*give, random.Random("7:1"))
        got = k.interleaved_lean(n, m, *[(*np.nonzero(g), g[np.nonzero(g)]) for g in give], random.Random("7:1"))
        assert got.tolist() == want
