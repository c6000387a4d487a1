"""Sequential kernels on one instance, in plain Python and numpy: a cluster runs as many instances at once as it has
cores (trees, thresholds, seeds, chains), each inside one task.

An instance is a Problem: labels by preorder, the tree, and soft edges in descending weight.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Problem:
    """parent: label of the parent or None, by label in preorder; leaves: labels that are leaves;
    edges: (donor, receptor, weight) with distinct pairs, weight > 0, heaviest first, ties by first appearance."""

    parent: dict
    leaves: set
    edges: list = field(default_factory=list)

    def __post_init__(self):
        self.labels = list(self.parent)
        self.number = {x: i for i, x in enumerate(self.labels)}
        self.inner = [x for x in self.labels if x not in self.leaves]
        self.children = {x: [] for x in self.labels}
        for x, p in self.parent.items():
            if p is not None:
                self.children[p].append(x)
        self.root = next(x for x, p in self.parent.items() if p is None)
        self.slot = {x: i for i, x in enumerate(self.inner)}

    def weights(self) -> np.ndarray:
        """w[d, r] of soft edges between internal nodes."""
        w = np.zeros((len(self.inner), len(self.inner)))
        for d, r, x in self.edges:
            if d in self.slot and r in self.slot and self.parent[r] != d:
                w[self.slot[d], self.slot[r]] += x
        return w

    def ancestors(self) -> list[int]:
        """Of each internal node its internal ancestors as bits."""
        bits = []
        for x in self.inner:
            p = self.parent[x]
            bits.append(0 if p is None else bits[self.slot[p]] | 1 << self.slot[p])
        return bits


class Reach:
    """Reflexive reachability under added edges: a bit set of descendants and one of ancestors for each node."""

    def __init__(self, n: int):
        self.down = [1 << i for i in range(n)]
        self.up = [1 << i for i in range(n)]

    def has(self, u: int, v: int) -> bool:
        return self.down[u] >> v & 1 == 1

    def add(self, u: int, v: int) -> None:
        if self.has(u, v):
            return
        below, above = self.down[v], self.up[u]
        # a node that reaches v already has all that v reaches, and likewise upwards
        for side, gained, rest in ((self.down, below, above & ~self.up[v]), (self.up, above, below & ~self.down[u])):
            while rest:
                low = rest & -rest
                side[low.bit_length() - 1] |= gained
                rest ^= low


def greedy(problem: Problem) -> tuple[list, float]:
    """An order from the heaviest edges that close no cycle with the tree and each other; and the weight left out.

    The order is the reverse of a depth-first postorder that takes nodes in preorder and the latest edge first.
    """
    n, number = len(problem.labels), problem.number
    reach, out = Reach(n), [[number[c] for c in problem.children[x]] for x in problem.labels]
    for x in problem.labels[1:]:
        reach.add(number[problem.parent[x]], number[x])
    for x in problem.inner:  # the tree's own edges come before all others
        for c in problem.children[x]:
            if c not in problem.leaves:
                out[number[x]].append(number[c])
    left = 0.0
    for d, r, w in problem.edges:
        if problem.parent.get(r) == d and r not in problem.leaves:
            continue
        u, v = number[d], number[r]
        if u != v and reach.has(v, u):
            left += w
        else:
            out[u].append(v)
            reach.add(u, v)
    leaf = [x in problem.leaves for x in problem.labels]
    seen, order = list(leaf), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        stack = [(start, len(out[start]))]
        while stack:
            u, k = stack.pop()
            while k and seen[out[u][k - 1]]:
                k -= 1
            if k:
                v = out[u][k - 1]
                seen[v] = True
                stack += [(u, k - 1), (v, len(out[v]))]
            else:
                order.append(problem.labels[u])
    return order[::-1], left


def mixing(problem: Problem, rng: random.Random) -> list:
    """Children's orders merged at each node so that the least weight is violated, from the leaves up.

    What a node costs after a prefix of the other order is a row of prefix sums, so a merge is one table of its
    two lengths. A tie is one coin, row by row.
    """
    w = problem.weights()
    # coins follow a postorder, left before right
    done: dict = {}
    stack = [(problem.root, False)]
    while stack:
        x, ready = stack.pop()
        kids = [c for c in problem.children[x] if c not in problem.leaves]
        if not ready:
            stack.append((x, True))
            stack += [(c, False) for c in reversed(kids)]
            continue
        parts = [done.pop(c) for c in kids]
        merged = _merge(parts[0], parts[1], w, rng) if len(parts) == 2 else (parts[0] if parts else [])
        done[x] = [*merged, problem.slot[x]]
    return [problem.inner[i] for i in reversed(done[problem.root])]


def _merge(a: list[int], b: list[int], w: np.ndarray, rng: random.Random) -> list[int]:
    """The cheapest interleaving of a and b, where what stands earlier here comes later in time."""
    ia, ib = np.array(a), np.array(b)
    rest = (iter(a), iter(b))
    return [next(rest[0 if first else 1]) for first in interleaved(w[np.ix_(ia, ib)], w[np.ix_(ib, ia)], rng)]


def interleaved(a_gives: np.ndarray, b_gives: np.ndarray, rng: random.Random) -> list[bool]:
    """Of the cheapest interleaving of two sequences, whether each element is the first one's. a_gives[i, j], b_gives[j, i]: the
    weight that goes from one to the other, which is lost where the receiving one comes after."""
    n, m = a_gives.shape
    # placing a[i] after b[:j] violates what b[:j] gives to a[i], and the other way round
    cost_a = np.cumsum(b_gives, axis=0).T
    cost_b = np.cumsum(a_gives, axis=0)
    take_a = np.ones((n + 1, m + 1), bool)
    take_a[0, :] = False
    last = [0.0] * (m + 1)
    for i in range(1, n + 1):
        from_a, from_b = cost_a[i - 1].tolist(), cost_b[i - 1].tolist()
        left, row, choice = 0.0, [0.0], []
        for j in range(1, m + 1):
            x, y = last[j] + from_a[j - 1], left + from_b[j - 1]
            first = rng.random() < 0.5 if x == y else x < y
            left = x if first else y
            row.append(left)
            choice.append(first)
        take_a[i, 1:] = choice
        last = row
    out, i, j = [], n, m
    while i or j:
        first = bool(take_a[i, j])
        i, j = (i - 1, j) if first else (i, j - 1)
        out.append(first)
    return out[::-1]


def interleaved_lean(n: int, m: int, a_gives, b_gives, rng: random.Random) -> np.ndarray:
    """The same as `interleaved`, coins included, of sequences of n and m elements and of weights as (giver, receiver, weight)
    arrays. Rows of the table are made from the one before; only each of some sqrt(n) rows is kept, and the choices between two of
    them are made again when the way back comes there. With integral weights, sums are exact and a row is made at once."""
    kind, words, at, *_ = ("MT19937", rng.getstate()[1][:-1], rng.getstate()[1][-1])
    coins = np.random.RandomState()  # the same generator as random.Random
    coins.set_state((kind, np.array(words, np.uint32), at))
    sides = []
    for row, column, w in ((a_gives[0], a_gives[1], a_gives[2]), (b_gives[1], b_gives[0], b_gives[2])):
        by = np.argsort(row, kind="stable")
        sides.append((np.searchsorted(row[by], np.arange(n + 1)), column[by], w[by]))
    exact = all((w == np.floor(w)).all() for *_, w in sides) and sum(np.abs(w).sum() for *_, w in sides) * (n + m + 1) < 2**53

    def given(side, i):
        begin, column, w = sides[side]
        out = np.zeros(m)
        np.add.at(out, column[begin[i] : begin[i + 1]], w[begin[i] : begin[i + 1]])
        return out

    def step(i, last, from_b):
        from_b = from_b + given(0, i)
        x = last[1:] + np.cumsum(given(1, i))
        row = np.zeros(m + 1)
        if exact:
            way = np.cumsum(from_b)
            row[1:] = way + np.minimum.accumulate(np.concatenate([[0.0], x - way]))[1:]
            y = row[:-1] + from_b
            first, tie = x < y, np.flatnonzero(x == y)
            first[tie] = coins.random_sample(len(tie)) < 0.5
        else:
            first, left, gives = np.zeros(m, bool), 0.0, from_b.tolist()
            for j, v in enumerate(x.tolist()):
                y = left + gives[j]
                first[j] = coins.random_sample() < 0.5 if v == y else v < y
                left = row[j + 1] = v if first[j] else y
        return row, from_b, first

    every, kept = 4 * max(1, math.isqrt(n)), []
    last, from_b = np.zeros(m + 1), np.zeros(m)
    for i in range(n):
        if i % every == 0:
            kept.append((last, from_b, coins.get_state()))
        last, from_b, _ = step(i, last, from_b)
    out, j, at = np.zeros(n + m, bool), m, n + m
    for block in reversed(range(len(kept))):
        last, from_b, state = kept.pop()
        coins.set_state(state)
        choices = []
        for i in range(block * every, min(n, (block + 1) * every)):
            last, from_b, first = step(i, last, from_b)
            choices.append(np.packbits(first))
        for take in reversed(choices):  # back through b until a's element was taken
            while j and not take[(j - 1) >> 3] & (128 >> ((j - 1) & 7)):
                j, at = j - 1, at - 1
            at -= 1
            out[at] = True
    return out


def value(problem: Problem, order: list) -> float:
    """The weight that an order violates, summed heaviest first."""
    at = {x: i for i, x in enumerate(order)}
    return math.fsum(w for d, r, w in problem.edges if d in at and r in at and at[d] > at[r])


def kendall(a: list, b: list) -> int:
    """Pairs that two orders of the same labels put differently, by counting inversions in a merge sort."""
    at = {x: i for i, x in enumerate(b)}

    def count(seq):
        if len(seq) < 2:
            return seq, 0
        mid = len(seq) // 2
        (x, p), (y, q) = count(seq[:mid]), count(seq[mid:])
        out, i, total = [], 0, p + q
        for v in y:
            while i < len(x) and x[i] < v:
                out.append(x[i])
                i += 1
            total += len(x) - i
            out.append(v)
        return out + x[i:], total

    return count([at[x] for x in a])[1]


def most_kendall(problem: Problem) -> int:
    """The largest distance of two legal orders: the pairs that the tree leaves open."""
    n = len(problem.inner)
    return n * (n - 1) // 2 - sum(b.bit_count() for b in problem.ancestors())


def similarity(problem: Problem, a: list, b: list) -> float:
    most = most_kendall(problem)
    return 1.0 if not most else (most - kendall(a, b)) / most


def random_order(problem: Problem, rng: random.Random) -> list:
    """A random legal order: at each node the children's orders are interleaved uniformly, the node first."""
    done: dict = {}
    stack = [(problem.root, False)]
    while stack:
        x, ready = stack.pop()
        kids = [c for c in problem.children[x] if c not in problem.leaves]
        if not ready:
            stack.append((x, True))
            stack += [(c, False) for c in reversed(kids)]
            continue
        parts = [done.pop(c) for c in kids]
        if len(parts) == 2:
            a, b = parts
            spots = list(range(len(a) + len(b)))
            for _ in b:
                del spots[int(rng.random() * len(spots))]
            out, own = [None] * (len(a) + len(b)), iter(a)
            for s in spots:
                out[s] = next(own)
            other = iter(b)
            parts = [[next(other) if v is None else v for v in out]]
        done[x] = [x, *(parts[0] if parts else [])]
    return done[problem.root]


class Walk:
    """An order with its value under moves and swaps; a move costs as much as the labels it crosses."""

    def __init__(self, problem: Problem, order: list):
        self.problem, self.w = problem, problem.weights()
        self.net = self.w - self.w.T
        self.above = problem.ancestors()
        self.order = np.array([problem.slot[x] for x in order])
        self.value = self.exact()
        self.steps = 0

    def exact(self) -> float:
        return float(np.tril(self.w[np.ix_(self.order, self.order)], -1).T.sum()) if len(self.order) else 0.0

    def labels(self) -> list:
        return [self.problem.inner[i] for i in self.order]

    def move_gain(self, i: int, j: int) -> float | None:
        """The change if the label at i goes to j > i; None where it would pass a descendant."""
        x, crossed = self.order[i], self.order[i + 1 : j + 1]
        if any(self.above[y] >> int(x) & 1 for y in crossed):
            return None
        return float(self.net[x, crossed].sum())

    def move(self, i: int, j: int, gain: float) -> None:
        x = self.order[i]
        self.order[i:j] = self.order[i + 1 : j + 1]
        self.order[j] = x
        self._settle(gain)

    def swap_gain(self, i: int, j: int) -> float | None:
        """The change if the labels at i < j change places; None where that breaks the tree's order."""
        x, y, mid = self.order[i], self.order[j], self.order[i + 1 : j]
        if self.above[y] >> int(x) & 1 or any(self.above[m] >> int(x) & 1 or self.above[y] >> int(m) & 1 for m in mid):
            return None
        return float(self.net[x, mid].sum() + self.net[mid, y].sum() + self.net[x, y])

    def swap(self, i: int, j: int, gain: float) -> None:
        self.order[i], self.order[j] = self.order[j], self.order[i]
        self._settle(gain)

    def _settle(self, gain: float) -> None:
        self.steps += 1
        self.value = self.exact() if self.steps % 1000 == 0 else self.value + gain


def pair(n: int, rng: random.Random) -> tuple[int, int]:
    """Two different positions, the smaller first."""
    i = int(rng.random() * n)
    j = int(rng.random() * (n - 1))
    j += j >= i
    return (i, j) if i < j else (j, i)


class Best:
    """The k best distinct orders seen, with visits; of equally bad ones the oldest goes first."""

    def __init__(self, k: int):
        if isinstance(k, bool) or int(k) != k or k < 1:
            raise ValueError("k must be an integer of at least 1")
        self.k, self.held = int(k), {}

    def see(self, order: tuple, val: float) -> None:
        if order in self.held:
            self.held[order][1] += 1
            return
        self.held[order] = [val, 1]
        if len(self.held) > self.k:
            worst = max(v for v, _ in self.held.values())
            del self.held[next(o for o, (v, _) in self.held.items() if v == worst)]

    def rows(self) -> list[tuple[list, float, int]]:
        return [(list(o), v, n) for o, (v, n) in sorted(self.held.items(), key=lambda x: x[1][0])]


def search(problem: Problem, start: list, iterations: int, temperature: float, rng: random.Random, keep: Best | None = None, stop=None) -> tuple[list, float, int]:
    """Metropolis search by moves from start; the best order, its value and the iterations made. stop(k) ends it."""
    walk = Walk(problem, start)
    best, best_value = list(start), walk.value
    for k in range(iterations if len(start) > 1 else 0):
        if stop is not None and stop(k):
            return best, best_value, k
        i, j = pair(len(start), rng)
        gain = walk.move_gain(i, j)
        if gain is not None and (gain <= 0 or rng.random() < math.exp(-gain / temperature if temperature > 0 else -math.inf)):
            walk.move(i, j, gain)
            if keep is not None:
                keep.see(tuple(walk.labels()), walk.value)
            if walk.value < best_value - 1e-12:
                best, best_value = walk.labels(), walk.value
    return best, best_value, iterations


def chain(problem: Problem, start: list, iterations: int, temperature: float, burn_in: int, thin: int, rng: random.Random, stop=None):
    """A Metropolis chain by swaps: (step, order, value) of every thin-th state after burn_in."""
    walk = Walk(problem, start)
    for k in range(burn_in + iterations):
        if stop is not None and stop(k):
            return
        if len(start) > 1:
            i, j = pair(len(start), rng)
            gain = walk.swap_gain(i, j)
            if gain is not None and (gain <= 0 or rng.random() < math.exp(max(-gain / temperature, -700.0) if temperature > 0 else -math.inf)):
                walk.swap(i, j, gain)
        if k >= burn_in and (k - burn_in) % thin == 0:
            yield (k - burn_in) // thin, walk.labels(), walk.value


def extensions(problem: Problem, limit: int | None = None):
    """Legal orders one by one, at most limit."""
    above, n, made = problem.ancestors(), len(problem.inner), 0
    stack: list[tuple[list[int], int]] = [([], 0)]
    while stack:
        prefix, used = stack.pop()
        if len(prefix) == n:
            yield [problem.inner[i] for i in prefix]
            made += 1
            if limit is not None and made >= limit:
                return
            continue
        stack += [([*prefix, i], used | 1 << i) for i in reversed(range(n)) if not used >> i & 1 and above[i] & ~used == 0]


def extension_count(problem: Problem) -> int:
    """n! over the product of subtree sizes."""
    size = dict.fromkeys(problem.inner, 1)
    for x in reversed(problem.inner):
        if problem.parent[x] is not None:
            size[problem.parent[x]] += size[x]
    return math.factorial(len(problem.inner)) // math.prod(size.values())
