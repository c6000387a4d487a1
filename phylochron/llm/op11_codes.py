"""Compression of vectors to product codes by integer k-means, with a kd-tree a codebook.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of a few entries. In a
round the driver builds a kd-tree of each codebook and broadcasts them (parts x entries small vectors, a size that does
not depend on the data); tasks find each part's nearest entry by branch and bound and send one sum a part position and
entry and task; Spark adds these up, and the driver divides parts x entries sums. A search starts with the leaf that
the part falls into and then visits every node whose box is not farther than the best so far. Nodes that are equally far are
visited too, so of entries at one distance the lowest index wins.

All arithmetic is on integers, so results do not depend on partitions, order or lost tasks. Integers saturate at a bound that
keeps every squared distance within 64 bits (32 768 before scaling for 64 components), far beyond any embedding.

Defined results: vectors that are null or empty, hold null or non-finite components, have a length that the number of parts
does not divide, or another length than the first of the others by vec_id, are left out; vectors with null vec_id come last among the
seeds, repeated vec_ids are ordered by their vectors and each is a seed of its own; with fewer vectors than entries a
codebook is that much shorter; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries that a leaf of a kd-tree holds at most.
LEAF = 2
#: Part vectors searched at once.
BATCH = 65_536
#: Labels up to this number are broadcast with their sums (16 bytes each); with more, label and salt are the join's keys.
FEW_LABELS, SALTS = 100_000, 16


class KdTree:
    """The entries of one codebook: nodes with bounding boxes, split at the median of the widest side."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.low, self.high, self.children, self.held = entries, [], [], [], []
        self._add(np.arange(len(entries)))

    def _add(self, index: np.ndarray) -> int:
        at, inside = len(self.low), self.entries[index]
        low, high = inside.min(axis=0), inside.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.held.append(np.sort(index))
        if len(index) > LEAF:
            by = index[np.argsort(inside[:, int(np.argmax(high - low))], kind="stable")]
            self.children[at] = (self._add(by[: len(by) // 2]), self._add(by[len(by) // 2 :]))
        return at

    def bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distances from points to a node's box: no entry in it is nearer."""
        out = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.einsum("ij,ij->i", out, out)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each point's nearest entry, ties to the lower index, and how many distances that took."""
        best, index, asked = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), 0

        def look(node, rows):
            nonlocal asked
            for k in self.held[node]:
                gap = x[rows] - self.entries[k]
                far = np.einsum("ij,ij->i", gap, gap)
                asked += len(rows)
                better = (far < best[rows]) | ((far == best[rows]) & (k < index[rows]))
                best[rows[better]], index[rows[better]] = far[better], k

        home = self._home(x)
        for leaf in np.unique(home):
            look(int(leaf), np.flatnonzero(home == leaf))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            rows = rows[self.bound(node, x[rows]) <= best[rows]]
            if not len(rows):
                continue
            if self.children[node] is None:
                look(node, rows[home[rows] != node])
            else:
                todo += [(child, rows) for child in self.children[node]]
        return index, best, asked

    def _home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each point descends to, at every node to the nearer box."""
        home, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                home[rows] = node
                continue
            one, two = self.children[node]
            right = self.bound(two, x[rows]) < self.bound(one, x[rows])
            todo += [(child, part) for child, part in ((one, rows[~right]), (two, rows[right])) if len(part)]
        return home


def quantised(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): usable vectors as integers, floor(scale * component)."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = given.select("vec_id", F.size("embedding").alias("d")).orderBy(F.col("vec_id").asc_nulls_last(), "d").limit(1).collect()
    size = first[0]["d"] if first else parts
    most = float((1 << 30) // (math.isqrt(size - 1) + 1))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-most)), F.lit(most))).cast("long"))
    return given.filter(F.size("embedding") == size).select("vec_id", "label", whole.alias("v"))


def seeds(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks (entry, component) of each part position: the parts of the vectors with the smallest ids."""
    rows = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return []
    return np.split(np.array([r["v"] for r in rows], np.int64), parts, axis=1)


def _points(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def improved(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: entries become the floored means of the parts that are nearest to them."""
    spark = vectors.sparkSession
    trees = spark.sparkContext.broadcast([KdTree(c) for c in codebooks])
    shape = codebooks[0].shape

    def run(batches):
        total = np.zeros((len(codebooks), *shape), np.int64)
        count = np.zeros((len(codebooks), shape[0]), np.int64)
        for b in _slices(batches):
            for p, (tree, x) in enumerate(zip(trees.value, np.split(_points(b.column(0)), len(codebooks), axis=1), strict=True)):
                index = tree.nearest(x)[0]
                np.add.at(total[p], index, x)
                count[p] += np.bincount(index, minlength=shape[0])
        used = [(p, k) for p in range(len(codebooks)) for k in range(shape[0]) if count[p, k]]
        columns = [pa.array([p for p, _ in used], pa.int32()), pa.array([k for _, k in used], pa.int32()), pa.array([int(count[u]) for u in used], pa.int64()), pa.array([total[u].tolist() for u in used], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    sums = vectors.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(shape[1])]
    out = [c.copy() for c in codebooks]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(shape[1])]
    trees.unpersist()
    return out


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after all rounds; vectors: a stored table of `quantised`."""
    codebooks = seeds(vectors, parts, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = improved(vectors, codebooks)
    return codebooks


def encoded(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to the entries named."""
    if codebooks and len(codebooks[0]) > 256:
        raise ValueError("a code has two hex digits a part, so a codebook has 256 entries at most")
    trees = vectors.sparkSession.sparkContext.broadcast([KdTree(c) for c in codebooks])

    def run(batches):
        for b in _slices(batches):
            code, error = np.zeros((b.num_rows, len(codebooks)), np.uint8), np.zeros(b.num_rows, np.int64)
            for p, (tree, x) in enumerate(zip(trees.value, np.split(_points(b.column(2)), len(codebooks), axis=1), strict=True)):
                index, far, _ = tree.nearest(x)
                code[:, p] = index
                error += far
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (stored) with label_error, the errors summed over equal labels, nulls together. The sums are one row a label;
    while their number is small they are broadcast, beyond that a frequent label is split by salt."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.count() <= FEW_LABELS:
        return codes.join(F.broadcast(sums.withColumnRenamed("label", "_of")), F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
    return salted(codes, sums)


def salted(codes: DataFrame, sums: DataFrame) -> DataFrame:
    """The same join by label and salt."""
    sums = sums.select(F.col("label").alias("_of"), "label_error", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("_at"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    out = codes.withColumn("_salt", salt)
    return out.join(sums, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_at"))).drop("_of", "_at", "_salt")


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "codes") as scratch:
        vectors = scratch.stored(quantised(table(spark, sf_dir, "embeddings")), "vectors")
        codebooks = trained(vectors)
        codes = scratch.result(encoded(vectors, codebooks), "codes")
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another, every entry compared with every part."""
    size = f"list_transform(range(0, {PARTS}), lambda p: struct_pack(p := p, x := v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})]))"
    far = "CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    assign = lambda r: f"""assigned{r} AS MATERIALIZED (
  SELECT vec_id, a.p, min(struct_pack(far := {far}, k := b.k)) AS near, any_value(a.x) AS x FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY vec_id, a.p
)"""  # noqa: E731
    steps = [assign(0)]
    for r in range(1, ROUNDS + 1):
        steps.append(f"""book{r} AS MATERIALIZED (
  SELECT o.p, o.k, COALESCE(n.x, o.x) AS x FROM book{r - 1} o LEFT JOIN (
    SELECT p, k, list(m ORDER BY i) AS x FROM (SELECT p, near.k AS k, i, CAST(floor(SUM(x[i]) / COUNT(*)) AS BIGINT) AS m
      FROM (SELECT p, near, x, unnest(range(1, len(x) + 1)) AS i FROM assigned{r - 1}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON n.p = o.p AND n.k = o.k
)""")
        steps.append(assign(r))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, u.p AS p, u.x AS x FROM (SELECT vec_id, label, unnest({size}) AS u FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, k, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)
), {", ".join(steps)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', near.k), '' ORDER BY p) AS code, CAST(SUM(near.far) AS BIGINT) AS error FROM assigned{ROUNDS} GROUP BY 1
)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM book{ROUNDS}) AS codebooks_sha256 FROM codes JOIN kept USING (vec_id)"""


ORACLE_SQL = _oracle()
