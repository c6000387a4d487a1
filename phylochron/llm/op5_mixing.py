"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a
target stops at twice its source's words and the excess is shared again by weight until none is above.
Rates: of all rates between 0 and 2 that give each source its target of words, those of least relative entropy
to one copy each are 2 * sigmoid(lambda * size / mean size), one lambda a source. Its convex dual is solved by
safeguarded Newton steps; a step is one aggregate over the histogram (source, size) -> documents, on which
rates solely depend, so no step reads the documents again.
Copies: in groups of a few thousand documents of one source, dealt by hash, the rate is rounded up or down to
whatever keeps the words taken closest to the sum of the rates, longest first; so each group is off by less
than a short document, a hot source is many groups, and reruns agree whatever the partitioning.

Defined results: null text has size 0; a source without words has target 0; a null source is a source of its
own, last; repeated rows (same doc_id, source and size) get the same copies; an empty table gives an empty
table; mixed() carries further columns, whatever their names.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, carried, chunks, per_doc, stored, table, utf8

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
TOLERANCE = 1e-7
GROUP = 4096
#: Up to so many sources their figures travel in the plan; beyond, as a stored table.
FEW_SOURCES = 10_000


def words_of(col: pa.Array) -> pa.Array:
    """The number of words of each text."""
    buf, at = utf8(col)
    first = ~SPACE[buf]
    head = at[:-1][at[1:] > at[:-1]]
    keep = first[head]
    first[1:] &= SPACE[buf[:-1]]
    first[head] = keep
    return pa.array(per_doc(first, at))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of each row."""

    def run(batches):
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words_of(b.column(2))], names=["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, size long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with weight and target. One row a source, so the numbering by code point is
    of sources, not of documents; each round of sharing brings two sums to the driver."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = stored(sources.withColumn("weight", weight), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap, level = F.col("source_size") * most, 0.0
    while True:
        over = F.col("weight") * level >= cap
        held, free = ranked.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (held or 0.0)) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def _kept(df: DataFrame, few: bool, name: str) -> DataFrame:
    """A table with one row a source, cut from its lineage."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if few else stored(df, name)


def tilt(lam, x):
    """The rate at a dual value: 2 * sigmoid(lambda * x)."""
    return 2.0 / (1.0 + F.exp(-F.least(F.lit(600.0), F.greatest(F.lit(-600.0), lam * x))))


def solve(histogram: DataFrame, sources: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """sources with the dual value lam of each; lo and hi bracket it. Ends when every source has its target or its bracket has
    closed, which halving ensures."""
    few = sources.count() <= FEW_SOURCES
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    state = _kept(sources.select("source", "source_size", "docs", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi")), few, "dual")
    while True:
        x = F.col("size") / F.col("mean")
        rate = tilt(F.col("lam"), x)
        words = F.col("n") * F.col("size")
        cell = histogram.join(state.select(F.col("source").alias("s"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s")))
        sums = cell.groupBy("s").agg(F.sum(words * rate).alias("got"), F.sum(words * x * rate * (1.0 - rate / 2.0)).alias("slope"))
        gap = F.col("target") - F.col("got")
        done = (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("target") >= MOST * F.col("source_size")) | (F.col("target") <= 0) | (F.col("hi") - F.col("lo") <= 1e-13 * (F.abs("lo") + F.abs("hi")))
        lo, hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))
        # a step that leaves the bracket, or is far longer than the last, is cut
        far = F.greatest(F.lit(4.0), F.abs("lam"))
        step = F.greatest(-far, F.least(far, gap / F.greatest(F.col("slope"), F.lit(1e-12))))
        nxt = F.col("lam") + step
        nxt = F.when((nxt <= lo) | (nxt >= hi), (lo + hi) / 2).otherwise(nxt)
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "docs", "target", "mean", F.when(done | F.col("got").isNull(), F.col("lam")).otherwise(nxt).alias("lam"), lo.alias("lo"), hi.alias("hi"), F.coalesce(done, F.lit(True)).alias("done"))
        new = _kept(new, few, "dual")
        state = new.drop("done")
        if not new.filter("NOT done").limit(1).count():
            return state


def rounded(units: DataFrame) -> DataFrame:
    """units (doc_id, source, size, n, rate, bucket) with copies."""

    def run(batch):
        size, n, rate = (batch.column(k).to_numpy() for k in ("size", "n", "rate"))
        tie = batch.column("tie").to_numpy()
        copies, owed = np.zeros(len(size), np.int64), 0.0
        for i in np.lexsort((tie, -(size * n))):
            low = math.floor(rate[i])
            part, words = rate[i] - low, float(size[i] * n[i])
            owed += part * words
            up = (owed > words / 2) if words else part >= 0.5
            if up and part > 0:
                low += 1
                owed -= words
            copies[i] = low
        return pa.Table.from_arrays([*[batch.column(k) for k in ("doc_id", "source", "size", "n")], pa.array(copies)], names=["doc_id", "source", "size", "n", "copies"])

    return units.groupBy("source", "bucket").applyInArrow(run, "doc_id long, source string, size long, n long, copies long")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (doc_id, source, size, n, copies) and the sources' table."""
    units = stored(sized(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    histogram = stored(units.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    sources = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")))
    dual = solve(histogram, sources).select(F.col("source").alias("s"), "source_size", "docs", "mean", "target", "lam")
    capped = F.col("target") >= MOST * F.col("source_size")
    rate = F.when(capped, F.lit(MOST)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilt(F.col("lam"), F.col("size") / F.col("mean")))
    rated = units.join(dual, F.col("source").eqNullSafe(F.col("s")))
    tie = F.xxhash64("doc_id", "size")
    rated = rated.select("doc_id", "source", "size", "n", rate.alias("rate"), tie.alias("tie"), F.pmod(tie, F.ceil(F.col("docs") / GROUP).cast("long")).alias("bucket"))
    return rounded(rated), dual


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    units, dual = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = units.join(dual.select("s", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def with_size(docs: DataFrame, name: str) -> DataFrame:
    """docs with the number of words of each text as the last column."""
    at = docs.columns.index("text")

    def run(batches):
        for b in chunks(batches, f"c{at}"):
            yield pa.RecordBatch.from_arrays([*b.columns, words_of(b.column(at))], names=[*b.schema.names, "x0"])

    return carried(docs, run, [(name, "long")])


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as it is taken; the columns of docs, whatever their names."""
    mark = uuid.uuid4().hex
    size, c = f"size_{mark}", f"copy_{mark}"
    units, _ = plan(docs)
    taken = units.filter("copies > 0").select(*[F.col(k).alias(f"{k}_{mark}") for k in ("doc_id", "source", "copies")], F.col("size").alias(f"words_{mark}"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"doc_id_{mark}")) & F.col("source").cast("string").eqNullSafe(F.col(f"source_{mark}")) & (F.col(size) == F.col(f"words_{mark}"))
    out = with_size(docs, size).join(taken, same)
    return out.withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"copies_{mark}")))).select(*[F.col(f"`{k}`") for k in docs.columns])
