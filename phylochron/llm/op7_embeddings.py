"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors are one class and one node. Nodes are dealt to shards by hash; each shard builds its graph (layers
by hash, batches inserted by beam search, diverse neighbours kept; the small topmost layer is compared as a whole to find entries). The shard then audits itself: PLANTED perturbed copies of
its own nodes, each within the threshold of at least one, are compared with the whole shard, and beams are widened until the mean
copy finds RECALL of its links. Nodes are dealt to blocks of queries as well; a block's task reads the shards' graphs from their
table one by one and asks each, so no vector is copied per shard and nothing is shuffled. It audits AUDIT queries of its own in the same
way and widens its beams further where they fail. Both audits have a fixed number of queries, so what they compare is linear in the
shard; a shard of few links is measured as well as one of many. A query whose beam is full of links gets a wider one, or
a comparison with the whole shard where that costs less, as all of its links must be counted. Candidates are verified by cosine in double precision.

A block returns for each query how many vectors it links to, and of its links with a shard a spanning forest only, so the rows
stay linear in the nodes however large a group of near copies is; components of the forests are those of all links.
Links are compared and reduced in pieces of PAIRS, so a group of near copies that fills a shard needs no more memory.
Shards and blocks grow with the nodes and are bounded by GROUP_BYTES. Every block reads every shard's graph, so what is read
grows with blocks times shards.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
vectors of different lengths never link; repeated rows are vectors of their own, those of one vec_id and vector
count once for each row; different vectors that are the first of their class under one vec_id share their links; an empty table gives an empty table; further columns are ignored.
audit_recall is the lowest share of links that an audit's mean query found with the beams used (1 where no audited query has links).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, table
from .graph import components
from .op3_warc import opened

COSINE = 0.95
#: Nodes of a shard, while there are few shards and at most; queries of a block likewise.
SHARD, MANY_SHARDS, SHARD_MOST = 2048, 4, 200_000
BLOCK, MANY_BLOCKS, BLOCK_MOST = 512, 16, 65_536
#: Links a node gets and keeps in a layer; beams for building, for the first asking and in the layers above; a layer holds a so-manieth of the one below.
LINKS, KEPT, BUILD_BEAM, BEAM, ENTRIES, THIN = 12, 24, 40, 12, 12, 32
#: Nodes that a beam opens at once (EXPAND * KEPT below 256); the topmost layer has at least TOP nodes, about THIN times as many at most.
EXPAND, TOP = 4, 64
#: Queries that a beam search takes at once, so that their vectors stay in a core's cache.
BATCH = 128
#: What a node costs that a beam looks at, in nodes of a comparison with the whole shard (about 80 measured on one core; fewer is careful). A wider beam that would cost more than the
#: whole shard isn't tried.
SINGLY = 8
#: Queries of the audits of a shard and of a block, and the share of its links that the mean one must find. So many planted copies tell shares a
#: few times finer than the one that may be lost: of 192, a single lost copy would be too many.
PLANTED, AUDIT, RECALL = 512, 48, 0.995
#: Pairs compared at once, and the bytes of vectors that a shard or a block of queries holds at most.
PAIRS, GROUP_BYTES = 4_000_000, 64 << 20


def against(q, x):
    """Products of all q with all x."""
    return q @ x.T


def pairwise(a, b):
    return np.einsum("ij,ij->i", a, b)


def unit(v):
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def beam(x, near, q, start, width: int):
    """Beam search of queries q in a layer: ids and similarities of the best `width`, best first (-1: none)."""
    n, out_id, out_s = len(x), np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf, np.float32)
    step = max(16, min(BATCH, 16_000_000 // max(n, 1)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        m = len(part)
        rows = np.arange(m)
        seen = np.zeros((m, n + 1), np.uint8)  # the last column stands for no neighbour
        seen[:, n] = 1
        ids = np.full((m, width), n, np.int64)
        sims = np.full((m, width), -np.inf, np.float32)
        todo = np.zeros((m, width), bool)
        s0 = start[lo : lo + step]
        k = min(s0.shape[1], width)
        s0 = s0[:, :k]
        once = ~np.tril(s0[:, :, None] == s0[:, None, :], -1).any(2)  # an entry that is given twice counts once
        ids[:, :k] = np.where(once, s0, n)
        sims[:, :k] = np.where(once, pairwise(x[s0.ravel()], np.repeat(part, k, 0)).reshape(m, k), -np.inf)
        todo[:, :k] = once
        np.put_along_axis(seen, ids, 1, 1)
        live, most = rows, min(EXPAND, width)
        while len(live):
            score = np.where(todo[live], sims[live], -np.inf)
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            ok = np.take_along_axis(score, best, 1) > -np.inf
            some = ok.any(1)
            live, best, ok = live[some], best[some], ok[some]
            if not len(live):
                break
            todo[live[:, None], best] = False
            nb = near[np.where(ok, ids[live[:, None], best], n)].reshape(len(live), -1)
            r, c = np.nonzero(seen[live[:, None], nb] == 0)
            node, row = nb[r, c], live[r]
            seen[row, node] = c + 1
            once = seen[row, node] == c + 1  # nodes opened together may share neighbours
            r, c, node, row = r[once], c[once], node[once], row[once]
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, c] = pairwise(x[node], part[row])
            all_s = np.concatenate([sims[live], s], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], nb], 1), top, 1)
            todo[live] = np.take_along_axis(np.concatenate([todo[live], s > -np.inf], 1), top, 1)
            sims[live] = np.take_along_axis(all_s, top, 1)
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[(sims == -np.inf) | (ids == n)] = -1
        out_id[lo : lo + m], out_s[lo : lo + m] = ids, sims
    return out_id, out_s


def diverse(x, cand, sim, most: int):
    """Of each row's candidates (best first, similarity -inf: none) those nearer to the row's node than to any kept one, filled
    up with the next best; -1 fills the rest."""
    m, kept, taken = len(cand), np.full((len(cand), most), -1, np.int64), np.zeros(cand.shape, bool)
    count = np.zeros(m, np.int64)
    for j in range(cand.shape[1]):
        live = np.flatnonzero((sim[:, j] > -np.inf) & (count < most))
        r, c = np.nonzero(kept[live] >= 0)
        near = np.full((len(live), most), -np.inf, np.float32)
        near[r, c] = pairwise(x[kept[live[r], c]], x[cand[live[r], j]])
        good = live[near.max(1, initial=-np.inf) < sim[live, j]]
        kept[good, count[good]] = cand[good, j]
        count[good] += 1
        taken[good, j] = True
    left = ~taken & (sim > -np.inf)
    at = count[:, None] + np.cumsum(left, 1) - 1
    r, c = np.nonzero(left & (at < most))
    kept[r, at[r, c]] = cand[r, c]
    return kept


def backlinked(x, near, new, chosen):
    """Adds to the neighbours of each chosen node the new ones that chose it; where there are more than KEPT, the diverse ones of
    the nearest stay."""
    n = len(x)
    r, c = np.nonzero(chosen >= 0)
    to, fro = chosen[r, c], new[r]
    every = np.unique(to)
    i, k = np.nonzero(near[every] < n)
    key = np.unique(np.concatenate([to * n + fro, every[i] * n + near[every[i], k]]))
    to, fro = key // n, key % n
    _, place, size = np.unique(to, return_inverse=True, return_counts=True)
    many = size > KEPT
    near[every[~many]] = n
    few = ~many[place]
    near[to[few], (np.arange(len(key)) - (np.cumsum(size) - size)[place])[few]] = fro[few]
    if many.any():
        to, fro, row = to[~few], fro[~few], (np.cumsum(many) - 1)[place[~few]]
        s = pairwise(x[fro], x[to])
        order = np.lexsort((fro, -s, row))
        row, fro, s = row[order], fro[order], s[order]
        size = size[many]
        rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        ok = rank < 2 * KEPT
        cand, sim = np.zeros((len(size), 2 * KEPT), np.int64), np.full((len(size), 2 * KEPT), -np.inf, np.float32)
        cand[row[ok], rank[ok]], sim[row[ok], rank[ok]] = fro[ok], s[ok]
        best = diverse(x, cand, sim, KEPT)
        near[every[many]] = np.where(best < 0, n, best)


def spread(n: int) -> np.ndarray:
    """Places of ENTRIES nodes, or of all n, where no layer above gives entries."""
    return np.arange(min(n, ENTRIES)) * n // min(n, ENTRIES)


class Graph:
    """The layers of a shard, from the top: node numbers and their neighbours in the layer."""

    def __init__(self, x: np.ndarray, hashes: np.ndarray):
        self.x = x
        n = len(x)
        u = ((mix(hashes ^ np.uint64(0x1234567)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        level = np.minimum((-np.log(u) / np.log(THIN)).astype(int), 8)
        self.layers = []
        top = int(level.max()) if n else 0
        while top > 0 and (level >= top).sum() < TOP:
            top -= 1
        for k in range(top, -1, -1):
            nodes = np.flatnonzero(level >= k)
            self.layers.append((nodes, self._layer(nodes)))

    def _layer(self, nodes):
        """Neighbours among nodes, by position; len(nodes) stands for none."""
        x, n = self.x[nodes], len(nodes)
        near = np.full((n + 1, KEPT), n, np.int64)
        done = 0
        # those already in the layer above come first, so that its answers are entries here
        above = self.layers[-1][0] if self.layers else nodes[:0]
        order = np.concatenate([np.searchsorted(nodes, above), np.setdiff1d(np.arange(n), np.searchsorted(nodes, above))])
        while done < n:
            new = order[done : done + min(max(64, done // 4), 256)]
            sims = against(x[new], x[new])
            np.fill_diagonal(sims, -np.inf)
            take = min(BUILD_BEAM, len(new) - 1)
            cand = np.zeros((len(new), 0), np.int64)
            sim = np.zeros((len(new), 0), np.float32)
            if take > 0:
                own = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                cand, sim = new[own], np.take_along_axis(sims, own, 1)
            if done:
                start = self.entries(x[new], nodes, len(self.layers)) if self.layers else np.repeat(order[spread(done)][None], len(new), 0)
                i, s = beam(x, near, x[new], start, BUILD_BEAM)
                cand, sim = np.concatenate([cand, np.where(i < 0, 0, i)], 1), np.concatenate([sim, np.where(i < 0, -np.inf, s)], 1)
            best = np.argsort(-sim, 1, kind="stable")[:, :BUILD_BEAM]
            cand, sim = np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1)
            chosen = diverse(x, cand, sim, LINKS)
            near[new] = n
            near[new, :LINKS] = np.where(chosen < 0, n, chosen)
            backlinked(x, near, new, chosen)
            done += len(new)
        return near

    def entries(self, q, nodes, layers: int):
        """For each query the nearest nodes that the layers above know, as positions in nodes. The topmost layer is small and compared as a whole."""
        top = self.layers[0][0]
        at = np.empty((len(q), min(ENTRIES, len(top))), np.int64)
        for lo in range(0, len(q), step := max(1, PAIRS // len(top))):
            at[lo : lo + step] = top[np.argpartition(-against(q[lo : lo + step], self.x[top]), at.shape[1] - 1, axis=1)[:, : at.shape[1]]]
        for own, near in self.layers[1:layers]:
            i, _ = beam(self.x[own], near, q, np.searchsorted(own, at), min(ENTRIES, len(own)))
            at = own[np.where(i < 0, i[:, :1], i)]
        return np.searchsorted(nodes, at)

    def ask(self, q, width: int):
        nodes, near = self.layers[-1]
        start = self.entries(q, nodes, len(self.layers) - 1) if len(self.layers) > 1 else np.repeat(spread(len(nodes))[None], len(q), 0)
        return beam(self.x, near, q, start, min(width, len(self.x)))


class Asked:
    """Queries against a graph. ids of the queries and reps of the nodes: where they are equal a pair is a self match; without
    them there is none."""

    def __init__(self, graph, raw: np.ndarray, q_raw: np.ndarray, least: float, ids=None, reps=None):
        self.graph, self.least, self.low = graph, least, np.float32(least - 1e-4)
        self.full, self.asked = unit(raw), unit(q_raw)
        self.q = self.asked.astype(np.float32)
        self.ids = np.arange(len(q_raw)) if ids is None else ids
        self.reps = np.full(len(raw), -1) if reps is None else reps

    def _verified(self, a, b):
        """The pairs of queries a and nodes b whose cosine is at least `least`."""
        keep = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            keep[s] = pairwise(self.asked[a[s]], self.full[b[s]]) >= self.least
        return a[keep], b[keep]

    def links(self, rows, width: int):
        """Links of the queries `rows` in pieces of at most PAIRS: those that beams of the width find, wider ones where a beam
        is full of links, and a comparison with the whole shard where that costs less."""
        n, todo = len(self.graph.x), [(rows, width)]
        while todo:
            rows, wide = todo.pop()
            whole = wide >= n or (wide > width and wide * KEPT * SINGLY >= n)
            step = max(1, PAIRS // max(n if whole else wide, 1))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                if whole:
                    r, near = np.nonzero(against(self.q[part], self.graph.x) >= self.low)
                else:
                    ids, sims = self.graph.ask(self.q[part], wide)
                    ended = (sims[:, -1] < self.low) | (ids[:, -1] < 0)  # a beam that is full of links may hide more
                    r, c = np.nonzero((sims >= self.low) & (ids >= 0) & ended[:, None])
                    near = ids[r, c]
                    if not ended.all():
                        todo.append((part[~ended], wide * 4))
                yield self._verified(part[r], near)

    def counts(self, rows, width: int):
        """How many links to other vectors each of the rows has, as beams of the width find them."""
        got = np.zeros(len(self.q), np.int64)
        for a, b in self.links(rows, width):
            got += np.bincount(a[self.ids[a] != self.reps[b]], minlength=len(got))
        return got[rows]

    def settled(self, rows, width: int):
        """(width, recall) of an audit of the rows: beams are widened until the mean of those with links finds RECALL of them."""
        n, recall = len(self.graph.x), 1.0
        true = self.counts(rows, n)  # compared with the whole shard
        rows, true = rows[true > 0], true[true > 0]
        while len(rows):
            recall = float((self.counts(rows, width) / true).mean())
            if recall >= RECALL or width >= n:
                break
            width = min(n, width + width // 4 + 1)
        return width, recall


def drawn(ids: np.ndarray, most: int) -> np.ndarray:
    """Places of at most so many ids, chosen by hash."""
    return np.sort(np.argsort(mix(ids.view(np.uint64) ^ np.uint64(0x2545F491)), kind="stable")[:most])


def planted(raw: np.ndarray, reps: np.ndarray, least: float) -> np.ndarray:
    """Perturbed copies of PLANTED nodes, with cosines from the threshold to 1."""
    x = unit(raw[drawn(reps, PLANTED)])
    rng = np.random.default_rng(len(raw))
    side = rng.normal(size=x.shape)
    side -= pairwise(side, x)[:, None] * x
    c = rng.uniform(least, 1, len(x))[:, None]
    return c * x + np.sqrt(1 - c * c) * side / np.maximum(np.linalg.norm(side, axis=1), 1e-9)[:, None]


def self_audited(graph, raw: np.ndarray, reps: np.ndarray, least: float):
    """(width, recall) of a shard by its planted copies."""
    probes = planted(raw, reps, least)
    return Asked(graph, raw, probes, least).settled(np.arange(len(probes)), min(BEAM, len(raw)))


def found(graph, raw: np.ndarray, q_raw: np.ndarray, least: float, ids=None, reps=None, width: int | None = None, audits: list | None = None):
    """(query, node) pairs of cosine at least `least`, in pieces, by beams of a width that both audits accept. audits gets what
    share of the links the audit of these queries found."""
    if width is None:
        width, recall = self_audited(graph, raw, np.arange(len(raw)) if reps is None else reps, least)
    asked = Asked(graph, raw, q_raw, least, ids, reps)
    width, recall = asked.settled(drawn(asked.ids, AUDIT), width)
    if audits is not None:
        audits.append(recall)
    yield from asked.links(np.arange(len(q_raw)), width)


class Forest:
    """A spanning forest of links that come in pieces; nodes are known by place."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of a piece that join trees."""
        u, v = self.label[a], self.label[b]
        apart = np.flatnonzero(u != v)
        _, first = np.unique(np.stack([u[apart], v[apart]]), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        taken = []
        for i in apart[first].tolist():
            x, y = root(int(u[i])), root(int(v[i]))
            if x != y:
                parent[x] = y
                taken.append(i)
        if parent:
            to = np.arange(len(self.label))
            old = np.fromiter(parent, np.int64, len(parent))
            to[old] = [root(x) for x in old.tolist()]
            self.label = to[self.label]
        return a[taken], b[taken]


def _read(batches):
    for b in batches:
        rows = []
        for v in b.column(1).to_pylist():
            ok = v is not None and len(v) > 0 and all(c is not None for c in v)
            arr = np.array(v, np.float64) if ok else None
            ok = ok and bool(np.isfinite(arr).all()) and bool((arr != 0).any())
            rows.append((arr / np.abs(arr).max()).tobytes() if ok else None)
        digest = [None if r is None else hashlib.md5(r).digest() for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([None if d is None else int.from_bytes(d[k : k + 8], "little", signed=True) for d in digest], pa.int64()) for k in (0, 8)], pa.array([0 if r is None else len(r) // 8 for r in rows], pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "d1", "d2", "dim", "vec"])


def _built(least: float):
    def run(key, group):
        shard, dim = key[0].as_py(), key[1].as_py()
        group = group.sort_by("rep")
        raw = np.frombuffer(b"".join(group.column("vec").to_pylist())).reshape(-1, dim)
        reps = group.column("rep").to_numpy().astype(np.int64)
        g = Graph(unit(raw).astype(np.float32), reps.view(np.uint64))
        width, recall = self_audited(g, raw, reps, least)
        return pa.Table.from_pydict({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "reps": [reps.tobytes()], "weights": [group.column("n").to_numpy().astype(np.int64).tobytes()], "raw": [raw.tobytes()], "layers": [[a.astype(np.int64).tobytes() for a, _ in g.layers]], "near": [[b.astype(np.int32).tobytes() for _, b in g.layers]], "width": pa.array([width], pa.int64()), "recall": [recall]})

    return run


_GRAPH = "shard int, dim int, reps binary, weights binary, raw binary, layers array<binary>, near array<binary>, width long, recall double"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("recall", pa.float64())])


def _graphs(path: str, dim: int):
    """The shards' graphs of vectors of a length, one by one: (graph, raw, reps, weights, width)."""
    fs, root = opened(path)
    table = pads.dataset(root, filesystem=fs, format="parquet")
    for batch in table.to_batches(columns=["reps", "weights", "raw", "layers", "near", "width"], filter=pads.field("dim") == dim, batch_size=1, batch_readahead=0, fragment_readahead=0, use_threads=False):
        for r in batch.to_pylist():
            raw = np.frombuffer(r["raw"]).reshape(-1, dim)
            graph = Graph.__new__(Graph)
            graph.x = unit(raw).astype(np.float32)
            graph.layers = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int32).astype(np.int64).reshape(-1, KEPT)) for a, b in zip(r["layers"], r["near"], strict=True)]
            yield graph, raw, np.frombuffer(r["reps"], np.int64), np.frombuffer(r["weights"], np.int64), r["width"]


def _asked(least: float, path: str):
    def run(key, group):
        dim = key[1].as_py()
        ids = group.column("rep").to_numpy().astype(np.int64)
        vecs = np.frombuffer(b"".join(group.column("vec").to_pylist())).reshape(-1, dim)
        out = []
        for graph, raw, reps, weights, width in _graphs(path, dim):
            count, one, two, audits = np.zeros(len(ids), np.int64), [ids[:0]], [ids[:0]], []
            every = np.unique(np.concatenate([ids, reps]))
            at_id, at_rep = np.searchsorted(every, ids), np.searchsorted(every, reps)
            trees = Forest(len(every))
            for a, b in found(graph, raw, vecs, least, ids, reps, width, audits):
                other = ids[a] != reps[b]
                a, b = a[other], b[other]
                count += np.bincount(a, weights=weights[b], minlength=len(ids)).astype(np.int64)
                u, v = trees.add(at_id[a], at_rep[b])
                one.append(every[u])
                two.append(every[v])
            some = np.flatnonzero(count)
            one, two = np.concatenate(one), np.concatenate(two)
            rows = len(some) + len(one)
            none = lambda k, t: pa.nulls(k, t)
            out.append(pa.Table.from_arrays([pa.concat_arrays([pa.array(np.concatenate([ids[some], one])), none(1, pa.int64())]), pa.concat_arrays([none(len(some), pa.int64()), pa.array(two), none(1, pa.int64())]), pa.concat_arrays([pa.array(np.concatenate([count[some], np.zeros(len(one), np.int64)])), none(1, pa.int64())]), pa.concat_arrays([none(rows, pa.float64()), pa.array(audits)])], schema=_LINKS))
        return pa.concat_tables(out)

    return run


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall of every row of vectors (vec_id, embedding)."""
    with Scratch(vectors.sparkSession, "embeddings") as scratch:
        stored = scratch.stored
        rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_read, "vec_id long, d1 long, d2 long, dim int, vec binary"), "vectors")
        classes = stored(rows.filter("dim > 0 AND vec_id IS NOT NULL").groupBy("d1", "d2", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
        nodes, longest = classes.agg(F.count("*"), F.max("dim")).first()
        fits = max(1, GROUP_BYTES // (8 * (longest or 1)))
        shards = max(1, min(MANY_SHARDS, nodes // SHARD), -(-nodes // min(SHARD_MOST, fits)))
        blocks = max(1, min(MANY_BLOCKS, nodes // BLOCK), -(-nodes // min(BLOCK_MOST, fits)))
        reps = rows.join(classes.select("rep", F.col("d1").alias("c1"), F.col("d2").alias("c2"), "n"), (F.col("vec_id") == F.col("rep")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))).dropDuplicates(["rep", "d1", "d2"])
        reps = stored(reps.select("rep", "n", "dim", "vec", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(blocks)).cast("int").alias("block")), "nodes")
        graphs = stored(reps.groupBy("shard", "dim").applyInArrow(_built(least), _GRAPH), "graphs")
        place = f"{scratch.folder}/graphs-{scratch.count}"
        got = stored(reps.repartition(blocks, "block").groupBy("block", "dim").applyInArrow(_asked(least, place), "a long, b long, links long, recall double"), "links")
        recall = got.agg(F.min("recall")).unionByName(graphs.agg(F.min("recall"))).agg(F.min("min(recall)")).first()[0]
        label = components(got.filter("b IS NOT NULL").select("a", "b"), stored)
        count = got.filter("a IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
        known = classes.join(count, F.col("rep") == F.col("a"), "left").join(label, F.col("rep") == F.col("node"), "left")
        known = known.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        out = rows.select("vec_id", "d1", "d2").join(known, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return scratch.result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(recall).cast("double")), "result")


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
