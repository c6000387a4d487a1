"""Reachability in graphs (keys, src, dst): a tree's order with further edges that were accepted. Several graphs are worked on at
once, told apart by keys.

A closure has up to the square of the nodes in pairs, so it is kept as blocks of a matrix of bits: nodes are numbered, SIDE of them
make a block, and a block of rows and columns is one row (i, j, bits) of a table, if it has any pair. No pair is shuffled or found
twice, and pairs are rows only where they are the result.

BAND blocks of rows make a band. Where no way leaves a band and comes back, and edges are few a node, bands are closed one after the
other, each after those it leads to: what a node reaches is what its own edges lead to and what those nodes reach, so the work is
edges times columns. A task makes one column of blocks of the band and reads the blocks of later bands one by one; cycles within a
band are components, whose nodes reach the same. There are as many steps as bands. Numbers keep the edges (`links`), so a closure
with further edges makes only the bands anew that lead to one.

Other graphs are closed as in Warshall's algorithm, a block of middle nodes after the other; each is a join of block rows with block
columns, so the work is a product of blocks. A task holds three blocks of SIDE * SIDE bits. There are as many steps as blocks.
"""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..shared import Parts, Steps
from . import scans

#: Nodes of a side of a block, a multiple of 64.
SIDE = 2048
#: Blocks of rows of a band, and the edges a node up to which bands are closed by their edges.
BAND, SPARSE = 8, 16


def accepted(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): the tree's own edges between internal nodes, and those of edges (donor, receptor) between different nodes."""
    own = tree.filter("parent IS NOT NULL AND NOT is_leaf").select(F.col("parent").alias("src"), F.col("label").alias("dst"))
    return own.unionByName(edges.filter("donor <> receptor").select(F.col("donor").alias("src"), F.col("receptor").alias("dst"))).distinct()


def reach(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst) of every pair with a way from src to dst, once each; a node reaches itself only on a cycle."""
    return pairs(*closed(edges, *keys), *keys)


def extended(known: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """The reach of a graph with more edges, from its reach before."""
    with Steps(known.sparkSession, "known") as steps:
        numbers = steps.stored(_numbered(known.select(*keys, "src", "dst").unionByName(edges.select(*keys, "src", "dst")), keys), "numbers")
        return pairs(*more(numbers, steps.stored(_packed(_ends(known, numbers, keys), keys), "blocks"), edges, *keys), *keys)


def closed(edges: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(numbers, blocks) of the reach: numbers (keys, label, at, and links where bands could be closed), and its pairs as blocks
    (keys, i, j, bits)."""
    with Steps(edges.sparkSession, "closed") as steps:
        numbers = steps.stored(_numbered(edges, keys), "numbers")
        ends = steps.stored(_ends(edges, numbers, keys).distinct(), "ends")
        bands = _bands(ends, numbers.count())
        if bands is not None:
            return steps.result(_linked(numbers, ends, keys), "numbers"), _by_bands(steps, ends, bands, keys)
        last = numbers.agg(F.max("at")).first()[0]
        blocks = steps.stored(_packed(ends, keys), "blocks")
        return steps.result(numbers, "numbers"), _through(steps, blocks, range(0 if last is None else last // SIDE + 1), keys)


def more(numbers: DataFrame, blocks: DataFrame, edges: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(numbers, blocks) of a closure with more edges. By bands, those that lead to no new edge stay. Else, what was known is closed,
    so a new way goes on only at ends of new edges: only their blocks are middle ones."""
    with Steps(edges.sparkSession, "more") as steps:
        edges, known = edges.select(*keys, "src", "dst"), numbers.select(*keys, "label", "at")
        new = edges.select(*keys, F.col("src").alias("label")).unionByName(edges.select(*keys, F.col("dst").alias("label"))).distinct().join(known, [*keys, "label"], "left_anti")
        start = (known.agg(F.max("at")).first()[0] or 0) + 1
        added = _counted(steps.stored(new, "new"), keys).withColumn("at", F.col("at") + start)
        known = steps.stored(known.unionByName(added), "numbers")
        ends = steps.stored(_ends(edges, known, keys).distinct(), "ends")
        if "links" in numbers.columns:
            every = steps.stored(numbers.select(*keys, F.col("at").alias("r"), F.explode("links").alias("c")).unionByName(ends).distinct(), "every")
            bands = _bands(every, known.count())
            if bands is not None:
                touched = {b for (b,) in ends.select(_band("r")).distinct().collect()}
                for b, (to, _) in bands.items():  # later bands are there before
                    if touched & {x // BAND for x in to}:
                        touched.add(b)
                return steps.result(_linked(known, every, keys), "numbers"), _by_bands(steps, every, bands, keys, blocks, set(bands) - touched)
        at = _located(ends, keys)
        both = blocks.unionByName(at.groupBy(*keys, "i", "j").applyInArrow(_pack(SIDE), _schema(known, keys)))
        blocks = steps.stored(both.groupBy(*keys, "i", "j").applyInArrow(_either, _schema(known, keys)), "blocks")
        middle = at.select(F.explode(F.array("i", "j")).alias("k")).distinct().collect()  # blocks of nodes
        return steps.result(known, "numbers"), _through(steps, blocks, sorted(r["k"] for r in middle), keys)


def pairs(numbers: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst): the pairs of blocks as rows. Blocks are dealt out first, as a small one may have very many pairs."""
    label = numbers.schema["label"].dataType
    names = numbers.withColumn("i", F.floor(F.col("at") / SIDE).cast("long")).groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct(F.pmod("at", F.lit(SIDE)).cast("int").alias("n"), "label"))).alias("src"))
    src, dst = names, names.select(*keys, F.col("i").alias("j"), F.col("src").alias("dst"))
    rows = blocks.join(src.hint("merge"), [*keys, "i"]).join(dst.hint("merge"), [*keys, "j"]).select(*keys, "src", "dst", "bits")
    rows = rows.repartition(max(1, min(blocks.count(), MOST_PARTS)))
    kind = ", ".join([*[f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys], f"src {label.simpleString()}", f"dst array<{label.simpleString()}>"])
    return rows.mapInArrow(_unpacked(len(keys), SIDE), kind).select(*keys, "src", F.explode("dst").alias("dst"))


#: Tasks among which blocks are dealt at most.
MOST_PARTS = 4000


def _numbered(edges: DataFrame, keys) -> DataFrame:
    """(keys, label, at): the nodes of each graph, numbered from 0."""
    ends = edges.select(*keys, F.col("src").alias("label")).unionByName(edges.select(*keys, F.col("dst").alias("label")))
    return _counted(ends.filter("label IS NOT NULL").distinct(), keys)


def _counted(nodes: DataFrame, keys) -> DataFrame:
    if not keys:
        return scans.ranked(nodes, "at", "label")
    return nodes.withColumn("at", (F.row_number().over(Window.partitionBy(*keys).orderBy("label")) - 1).cast("long"))


def _ends(edges: DataFrame, numbers: DataFrame, keys) -> DataFrame:
    """(keys, r, c): the numbers of both ends of each edge."""
    end = lambda name, at: numbers.select(*keys, F.col("label").alias(name), F.col("at").alias(at))
    return edges.select(*keys, "src", "dst").join(end("src", "r"), [*keys, "src"]).join(end("dst", "c"), [*keys, "dst"]).select(*keys, "r", "c")


def _located(ends: DataFrame, keys) -> DataFrame:
    """(keys, i, j, r, c): the block of each edge and its place there."""
    block = lambda c: F.floor(F.col(c) / SIDE).cast("long")
    return ends.select(*keys, block("r").alias("i"), block("c").alias("j"), F.pmod("r", F.lit(SIDE)).alias("r"), F.pmod("c", F.lit(SIDE)).alias("c"))


def _schema(of: DataFrame, keys) -> StructType:
    return StructType([StructField(k, of.schema[k].dataType) for k in keys] + [StructField("i", LongType()), StructField("j", LongType()), StructField("bits", BinaryType())])


def _packed(ends: DataFrame, keys) -> DataFrame:
    return _located(ends, keys).groupBy(*keys, "i", "j").applyInArrow(_pack(SIDE), _schema(ends, keys))


def _linked(numbers: DataFrame, ends: DataFrame, keys) -> DataFrame:
    """numbers with links: the numbers of the nodes that a node has an edge to, null if none."""
    links = ends.groupBy(*keys, F.col("r").alias("at")).agg(F.collect_list("c").alias("links"))
    return numbers.join(links.hint("merge"), [*keys, "at"], "left").select(*keys, "label", "at", "links")


def _band(of: str, size: int | None = None):
    return F.floor(F.col(of) / (size or SIDE * BAND)).cast("long").alias("band")


def _bands(ends: DataFrame, nodes: int) -> dict[int, tuple[set[int], set[int]]] | None:
    """Of each band, in an order in which it is after those it leads to: the blocks of nodes that its edges lead to, and those it
    reaches. None if ways between bands run in circles or edges are many. The driver gets a row for a band and a block."""
    if ends.count() > SPARSE * nodes:
        return None
    to: dict[int, set[int]] = {}
    for band, j in ends.select(_band("r"), F.floor(F.col("c") / SIDE).cast("long")).distinct().collect():
        to.setdefault(band, set()).add(j)
    try:
        order = [b for b in TopologicalSorter({b: {j // BAND for j in x} - {b} for b, x in to.items()}).static_order() if b in to]
    except CycleError:
        return None
    out: dict[int, tuple[set[int], set[int]]] = {}
    for b in order:
        out[b] = to[b], to[b].union(*[out[j // BAND][1] for j in to[b] if j // BAND in out])
    return out


def _by_bands(steps: Steps, ends: DataFrame, bands, keys, blocks: DataFrame | None = None, kept=frozenset()) -> DataFrame:
    """The closure's blocks, made a band after the other; kept: bands that are as in `blocks`."""
    side, spark = SIDE, ends.sparkSession
    place = F.pmod("r", F.lit(side * BAND)) * side + F.pmod("c", F.lit(side))
    links = ends.groupBy(*keys, _band("r"), F.floor(F.col("c") / side).cast("long").alias("i")).agg(F.collect_list(place.cast("int")).alias("links"))
    links, kind, whole = steps.stored(links, "links"), _schema(ends, keys), Parts(spark, "closed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = dict.fromkeys(kept, whole.stored(blocks.filter(_band("i", BAND).isin(sorted(kept))), -1)) if kept else {}
    for b, (to, reached) in bands.items():
        if b in kept:
            continue
        columns = F.explode(F.array(*[F.lit(j).cast("long") for j in sorted(reached)])).alias("j")
        rows = links.filter(F.col("band") == b).select(*keys, "i", columns, "links", F.lit(None).cast("binary").alias("bits"))
        for other in {j // BAND for j in to} & set(made):
            far = made[other].filter(F.col("i").isin([j for j in to if j // BAND == other]))
            rows = rows.unionByName(far.select(*keys, "i", "j", F.lit(None).cast("array<int>").alias("links"), "bits"))
        rows = rows.repartition(max(parts, 2 * len(reached)), *keys, "j").sortWithinPartitions(*keys, "j", F.col("links").isNull(), "i")
        made[b] = whole.stored(rows.mapInArrow(_closed_band(len(keys), b, side, BAND), kind), b)
    return whole.whole(next(iter(made.values()))) if made else spark.createDataFrame([], kind)


def components(ways: list[list[int]]) -> list[list[int]]:
    """The strongly connected components of nodes 0, 1, ..., ways[x] the nodes after x; each is after those it leads to."""
    seen, low, open_, stack, out = [-1] * len(ways), [0] * len(ways), [False] * len(ways), [], []
    count = 0
    for start in range(len(ways)):
        todo = [] if seen[start] >= 0 else [(start, iter(()))]
        while todo:
            x, rest = todo[-1]
            if seen[x] < 0:
                seen[x] = low[x] = count
                count += 1
                stack.append(x)
                open_[x] = True
                todo[-1] = (x, rest := iter(ways[x]))
            for y in rest:
                if seen[y] < 0:
                    todo.append((y, iter(())))
                    break
                if open_[y]:
                    low[x] = min(low[x], seen[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == seen[x]:
                    k = len(stack) - 1
                    while stack[k] != x:
                        k -= 1
                    out.append(stack[k:])
                    del stack[k:]
                    for y in out[-1]:
                        open_[y] = False
    return out


#: Edges whose rows of bits a task of a band looks up at once.
AT_ONCE = 32_768


def _closed_band(keys: int, band: int, side: int, size: int):
    """Rows (keys, i, j, links, bits) sorted by keys and j: of each j, first the edges of the band to blocks i, then the blocks i
    of other bands. Gives the blocks (keys, i, j, bits) of the band."""

    def plan(links):
        """How many rows the band has, and its components: their nodes, and the rows that they put together."""
        inside = [(r, (i % size) * side + c) for i, (r, c) in links.items() if i // size == band]
        rows = 1 + max(int(x.max()) for x in [*[r for r, _ in links.values()], *[c for _, c in inside]])
        ways: list[list[int]] = [[] for _ in range(rows)]
        for r, c in inside:
            for x, y in zip(r.tolist(), c.tolist(), strict=True):
                ways[x].append(y)
        together = [(own, sorted({*own, *[y for x in own for y in ways[x]]})) for own in components(ways)]
        return rows, [(np.array(own), np.array(x)) for own, x in together if len(x) > 1]

    def started(links, rows, j):
        bits = np.zeros((-(-rows // side) * side, side // 64), np.uint64)
        if j in links:
            r, c = links[j]
            np.bitwise_or.at(bits.view(np.uint8), (r, c >> 3), (128 >> (c & 7)).astype(np.uint8))
        return bits

    def gained(bits, links, right):
        """bits with the rows of another band's block that the edges lead to."""
        for low in range(0, len(links[0]), AT_ONCE):
            r, c = (x[low : low + AT_ONCE] for x in links)
            first = np.flatnonzero(np.diff(r, prepend=-1))
            bits[r[first]] |= np.bitwise_or.reduceat(right[c], first, axis=0)

    def done(own, names, j, bits, steps):
        for nodes, rows in steps:
            bits[nodes] = np.bitwise_or.reduce(bits[rows], axis=0)
        for k in range(len(bits) // side):
            if (one := bits[k * side : (k + 1) * side]).any():
                yield pa.RecordBatch.from_arrays([*own, pa.array([band * size + k], pa.int64()), pa.array([j], pa.int64()), pa.array([one.tobytes()], pa.binary())], names=[*names, "i", "j", "bits"])

    def run(batches):
        at = graph = None  # the column and graph of these rows, and whose edges `planned` is of
        links, bits, planned = {}, None, (0, [])
        for b in batches:
            names = b.schema.names[:keys]
            for n in range(b.num_rows):
                key, i, j = tuple(b.column(k)[n].as_py() for k in range(keys)), b.column(keys)[n].as_py(), b.column(keys + 1)[n].as_py()
                if at != (key, j):
                    if at:
                        planned = planned if graph == at[0] else plan(links)
                        graph, bits = at[0], started(links, planned[0], at[1]) if bits is None else bits
                        yield from done(own, names, at[1], bits, planned[1])
                    at, own, links, bits = (key, j), [b.column(k).slice(n, 1) for k in range(keys)], {}, None
                if b.column(keys + 2)[n].is_valid:
                    r, c = np.divmod(np.sort(b.column(keys + 2)[n].values.to_numpy()), side)
                    links[i] = r, c
                elif i in links:
                    if bits is None:
                        planned = planned if graph == key else plan(links)
                        graph, bits = key, started(links, planned[0], j)
                    gained(bits, links[i], _words(b.column(keys + 3)[n], side))
        if at:
            planned = planned if graph == at[0] else plan(links)
            yield from done(own, names, at[1], started(links, planned[0], at[1]) if bits is None else bits, planned[1])

    return run


def _through(steps: Steps, blocks: DataFrame, middle, keys) -> DataFrame:
    """blocks closed over ways through the nodes of the blocks `middle`. Of each, its own block is closed, then its row is what
    that block leads to, then every block gains what its row reaches through the middle one."""
    kind = _schema(blocks, keys)
    for k in middle:
        row, rest = blocks.filter(F.col("i") == k), blocks.filter(F.col("i") != k)
        own = row.filter(F.col("j") == k).mapInArrow(_own(SIDE), kind).select(*keys, "i", F.col("bits").alias("left"))
        row = row.join(own.hint("merge"), [*keys, "i"], "left").select(*keys, "i", "j", F.when(F.col("j") == k, F.col("left")).otherwise(F.col("bits")).alias("bits"), "left", F.when(F.col("j") != k, F.col("bits")).alias("right"))
        row = steps.replaced(row.mapInArrow(_grown(SIDE), kind), "row")
        left = rest.filter(F.col("j") == k).select(*keys, "i", F.col("bits").alias("left"))
        right = row.select(*keys, "j", F.col("bits").alias("right"))
        made = left.select(*keys, "i").join(right.select(*keys, "j"), list(keys)) if keys else left.select("i").crossJoin(right.select("j"))
        every = rest.join(made.hint("merge"), [*keys, "i", "j"], "full").join(left.hint("merge"), [*keys, "i"], "left").join(right.hint("merge"), [*keys, "j"], "left")
        every = every.select(*keys, "i", "j", "bits", "left", "right").mapInArrow(_grown(SIDE), kind)
        blocks = steps.replaced(row.unionByName(every), "closed")
    return steps.result(blocks, "closed")


def _pack(side: int):
    """Rows (keys, i, j, r, c) of one block as its bits."""

    def run(key, group):
        bits = np.zeros((side, side), bool)
        bits[group.column("r").to_numpy(), group.column("c").to_numpy()] = True
        return group.slice(0, 1).drop_columns(["r", "c"]).append_column("bits", pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()))

    return run


def _either(key, group):
    """Rows of one block as one."""
    bits = np.frombuffer(group.column("bits")[0].as_py(), np.uint8).copy()
    for x in group.column("bits")[1:]:
        bits |= np.frombuffer(x.as_py(), np.uint8)
    return group.slice(0, 1).drop_columns(["bits"]).append_column("bits", pa.array([bits.tobytes()], pa.binary()))


def _words(bits, side: int) -> np.ndarray:
    return np.frombuffer(bits.as_buffer(), np.uint64).reshape(side, side // 64)


def _own(side: int):
    """Blocks (..., bits) of the same nodes on both sides, closed by Warshall's algorithm."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                bits = _words(b.column("bits")[at], side).copy()
                as_bytes = bits.view(np.uint8)
                for m in range(side):
                    to = np.flatnonzero(as_bytes[:, m >> 3] & (128 >> (m & 7)))
                    if len(to):
                        bits[to] |= bits[m]
                yield b.slice(at, 1).set_column(b.num_columns - 1, "bits", pa.array([bits.tobytes()], pa.binary()))

    return run


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of two blocks as relations. The rows of `right` are looked up eight at a time, in a table of all they make."""
    out, by = np.zeros_like(right), left.view(np.uint8)
    for g in range(by.shape[1]):
        some, rows = by[:, g], right[8 * g : 8 * g + 8]
        if some.any() and rows.any():
            made = np.zeros((256, right.shape[1]), np.uint64)
            for b in range(8):  # the last column of eight is the lowest bit
                made[1 << b : 2 << b] = made[: 1 << b] | rows[7 - b]
            out |= made[some]
    return out


def _grown(side: int):
    """Blocks (..., bits, left, right) with what left and right make together, where there are both; bits may be null then."""

    def run(batches):
        for b in batches:
            last = b.num_columns - 3
            for at in range(b.num_rows):
                bits, left, right = (b.column(last + k)[at] for k in range(3))
                out = bits
                if left.is_valid and right.is_valid:
                    made = product(_words(left, side), _words(right, side))
                    out = (made | _words(bits, side)) if bits.is_valid else made
                    out = pa.scalar(out.tobytes(), pa.binary()) if out.any() else None
                if out is not None:
                    own = [c.slice(at, 1) for c in b.columns[:last]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([out.as_py()], pa.binary())], names=[*b.schema.names[:last], "bits"])

    return run


def _unpacked(keys: int, side: int):
    """Rows (keys, src, dst, bits), src and dst the numbered labels of both sides, as rows (keys, src, dst): a label and all that it
    reaches in the block."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                place, label = [], []
                for k in range(2):
                    x = b.column(keys + k)[at].values
                    place.append(np.zeros(side, np.int64))
                    place[k][x.field("n").to_numpy()] = np.arange(len(x))
                    label.append(x.field("label"))
                bits = np.frombuffer(b.column(keys + 2)[at].as_buffer(), np.uint8).reshape(side, side // 8)
                for low in range(0, side, 128):  # rows of 262 144 pairs at most
                    found = np.flatnonzero(np.unpackbits(bits[low : low + 128]).view(bool))
                    ends = np.searchsorted(found, np.arange(len(bits[low : low + 128]) + 1) * side)
                    r = np.flatnonzero(np.diff(ends))
                    if len(r):
                        one = [b.column(k).slice(at, 1).take(pa.array(np.zeros(len(r), np.int64))) for k in range(keys)]
                        reached = pa.ListArray.from_arrays(pa.array(np.append(ends[r], len(found)).astype(np.int32)), label[1].take(pa.array(place[1][found % side])))
                        yield pa.RecordBatch.from_arrays([*one, label[0].take(pa.array(place[0][r + low])), reached], names=[*b.schema.names[:keys], "src", "dst"])

    return run


def cycles(reach: DataFrame, *keys: str) -> DataFrame:
    """(keys, label): nodes on a cycle; an acyclic graph has none."""
    return reach.filter("src = dst").select(*keys, F.col("src").alias("label"))


def in_neighbours(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, donors, weight, heaviest): for each label that has any, how many different donors point to it, their weight,
    and the donor with the largest weight (of several, the smallest). A sparse table: labels without donors have no row."""
    by = edges.filter("donor <> receptor").groupBy(*keys, "donor", "receptor").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct(F.col("weight").alias("w"), (-F.col("donor")).alias("d")))
    return by.groupBy(*keys, F.col("receptor").alias("label")).agg(F.count("*").alias("donors"), F.sum("weight").alias("_w"), best.alias("_b")).select(*keys, "label", "donors", F.col("_w").alias("weight"), (-F.col("_b.d")).alias("heaviest"))
