"""Toxicity by a convolutional text classifier, trained in numpy.

Words (ASCII lower case, ASCII punctuation apart) get the sum of two hashed embeddings, so two words are alike
only if both their buckets meet. Filters of several widths run over the whole text, their largest values are
pooled and a logistic layer reads them. The first embedding component starts from the words' log-odds in the
training texts; filters and the logistic layer are then trained by Adam on the gradients through the pooled positions,
and the embeddings of the pooled words by plain gradient steps.
Thresholds are calibrated by language on rows kept apart: the language is guessed from the words of the text
itself, never read from a column, and a text's score is the sigmoid of its margin over that threshold. A language has a
threshold of its own if OWN rows of each class are among the rows kept apart; all others share one.

The model is fitted on the driver on at most SAMPLE labelled rows of each class, chosen by hash of their id
(the documented bound; as ids may repeat, 4 * SAMPLE texts in all); scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts are scored by what the pooled zeros give; rows without label, or with a
null label, are not learned from; without labels of both classes every score is 0; repeated rows score alike;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, chunks, crc_fold, table, utf8

SAMPLE = 3000
BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 4
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 300, 64, 0.01, 7
#: Rows of each class that a language needs for a threshold of its own.
OWN = 20

_APART = np.ones(256, bool)
_APART[128:] = False
_APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def buckets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both buckets of every word, and each text's first word."""
    w = Words(*utf8(col), LOWER, _APART)
    mask = np.uint64((1 << BITS) - 1)
    return (w.hash & mask).astype(np.int32), ((w.hash >> np.uint64(32)) & mask).astype(np.int32), w.first


def all_buckets(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """buckets() of many texts, a bounded batch at a time."""
    a, b, count = [], [], []
    for part in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]):
        x, y, first = buckets(part.column(0))
        a.append(x)
        b.append(y)
        count.append(np.diff(first))
    return np.concatenate(a), np.concatenate(b), np.concatenate([[0], np.cumsum(np.concatenate(count))])


class Model:
    def __init__(self, rng):
        size = 1 << BITS
        self.e = [rng.normal(0, 0.02, (size, DIM)).astype(np.float32) for _ in range(2)]
        self.w = [rng.normal(0, 0.25, (n * DIM, FILTERS)).astype(np.float32) for n in WIDTHS]
        for w in self.w:
            w[0, 0] = 1.0
            w[0, 1] = -1.0
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(1, np.float32)
        self.lang = np.zeros((size, 1), np.float32)
        self.cut = np.zeros(1, np.float32)

    def pooled(self, a, b, first, places: bool = False):
        """The largest value, at least 0, of each filter in each text; and where it is."""
        docs = len(first) - 1
        x = self.e[0][a]
        x += self.e[1][b]
        pool = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(pool.shape, -1, np.int64)
        count = np.diff(first)
        # one product for the filters of all widths, a contiguous row for each
        rows = np.concatenate([w.reshape(n, DIM, FILTERS).transpose(0, 2, 1).reshape(n * FILTERS, DIM) for n, w in zip(WIDTHS, self.w, strict=True)]) @ x.T
        low = 0
        for j, n in enumerate(WIDTHS):
            m, some = len(x) - n + 1, np.flatnonzero(count >= n)
            part = rows[low : low + n * FILTERS].reshape(n, FILTERS, len(x))
            low += n * FILTERS
            if not len(some):
                continue
            y = part[0][:, :m]
            for k in range(1, n):
                y += part[k][:, k : k + m]
            y += self.b[j][:, None]
            if n > 1:  # windows that run into the next text count for nothing
                ends = first[1:][count > 0]
                for k in range(1, n):
                    late = ends - k
                    y[:, late[(late >= 0) & (late < m)]] = -1e9
            starts = first[:-1][some]
            # between the starts of two texts lie only windows of the first one, and of texts too short
            best = np.maximum.reduceat(y, starts, axis=1).T
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            pool[some, cols] = np.maximum(best, 0)
            if places:
                for i, (d, s, e) in enumerate(zip(some, starts, first[1:][some] - n + 1, strict=True)):
                    where[d, cols] = np.where(best[i] > 0, s + y[:, s:e].argmax(1), -1)
        return pool, where

    def logits(self, a, b, first):
        return self.pooled(a, b, first)[0] @ self.out + self.bias[0]

    def language(self, a, first):
        """The calibration group of each text, from its words."""
        total = np.zeros((len(first) - 1, self.lang.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            total[some] = np.add.reduceat(self.lang[a], first[:-1][some], axis=0)
        return total.argmax(1)

    def scores(self, col: pa.Array) -> np.ndarray:
        a, b, first = buckets(col)
        z = self.logits(a, b, first) - self.cut[self.language(a, first)]
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def _by_text(at, first, size, weights):
    """Texts of each group that hold the bucket at least once: columns of a [size, groups] table."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.unique(at.astype(np.int64) * len(first) + doc)
    out = np.zeros((size, weights.shape[1]), np.float32)
    np.add.at(out, pair // len(first), weights[pair % len(first)])
    return out


def fit(texts: list, labels: np.ndarray, languages: list, seed: int = SEED) -> Model | None:
    """A model from whole texts; a quarter of them sets the thresholds only."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    model = Model(rng)
    a, b, first = all_buckets(texts)
    size = 1 << BITS
    apart = np.arange(len(texts)) % 4 == 3
    own = np.flatnonzero(~apart)
    y = labels.astype(np.float32)
    part = np.stack([(y == 1) & ~apart, (y == 0) & ~apart], 1).astype(np.float32)
    for e, at in zip(model.e, (a, b), strict=True):
        seen = _by_text(at, first, size, part)
        prior = part.sum(0)
        odds = np.log((seen[:, 0] + 2 * prior[0] / prior.sum()) / (seen[:, 1] + 2 * prior[1] / prior.sum()) * prior[1] / prior[0])
        e[:, 0] = 0.5 * np.where(seen.sum(1) >= 5, odds, 0)
    kept = [{x: int(n) for x, n in Counter(x for x, c, k in zip(languages, labels.tolist(), apart.tolist(), strict=True) if k and c == one and x is not None).items()} for one in (0, 1)]
    names = sorted(x for x in kept[0] if min(kept[0][x], kept[1].get(x, 0)) >= OWN)
    place = {x: i for i, x in enumerate(names)}
    names.append("")  # all other languages
    group = np.array([place.get(x, len(place)) for x in languages])
    member = (group[:, None] == np.arange(len(names))).astype(np.float32) * ~apart[:, None]
    by_lang = _by_text(a, first, size, member) + 0.5
    share = by_lang / (member.sum(0) + 1.0)
    model.lang = np.where(by_lang.sum(1, keepdims=True) > 0.5 * len(names) + 3, np.log(share) - np.log(share).mean(1, keepdims=True), 0).astype(np.float32)

    params = [*model.w, *model.b, model.out, model.bias]
    mom = [np.zeros_like(p) for p in params]
    var = [np.zeros_like(p) for p in params]
    rate = {True: 0.5 * len(own) / max(y[own].sum(), 1), False: 0.5 * len(own) / max((1 - y[own]).sum(), 1)}
    step = 0
    for _ in range(max(EPOCHS, STEPS * BATCH // max(len(own), 1))):  # few rows are seen more often
        for lo in range(0, len(own), BATCH):
            docs = rng.permutation(own)[:BATCH] if lo == 0 else order[lo : lo + BATCH]
            if lo == 0:
                order = rng.permutation(own)
                docs = order[:BATCH]
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            start = np.concatenate([[0], np.cumsum(first[docs + 1] - first[docs])])
            pool, where = model.pooled(a[at], b[at], start, places=True)
            z = pool @ model.out + model.bias[0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = (p - y[docs]) * np.where(y[docs] == 1, rate[True], rate[False]) / len(docs)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = pool.T @ g + 1e-4 * model.out, np.array([g.sum()], np.float32)
            back = g[:, None] * model.out
            nw = len(WIDTHS)
            for j, n in enumerate(WIDTHS):
                for f in range(FILTERS):
                    c = j * FILTERS + f
                    d = np.flatnonzero(where[:, c] >= 0)
                    grads[nw + j][f] = back[d, c].sum()
                    for k in range(n):
                        word = at[where[d, c] + k]
                        x = model.e[0][a[word]] + model.e[1][b[word]]
                        grads[j][k * DIM : (k + 1) * DIM, f] = x.T @ back[d, c]
                        move = -0.3 * back[d, c, None] * model.w[j][k * DIM : (k + 1) * DIM, f]
                        for e, bucket in zip(model.e, (a, b), strict=True):
                            np.add.at(e, bucket[word], move)
            step += 1
            for q, grad, m, v in zip(params, grads, mom, var, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    rows = np.flatnonzero(apart)
    z, guess = np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
    for d in rows:
        own = slice(first[d], first[d + 1])
        z[d] = model.logits(a[own], b[own], np.array([0, first[d + 1] - first[d]]))[0]
        guess[d] = model.language(a[own], np.array([0, first[d + 1] - first[d]]))[0]
    whole = _threshold(z[rows], y[rows], 0.0)
    model.cut = np.array([_threshold(z[r], y[r], whole) if min((y[r] == 1).sum(), (y[r] == 0).sum()) >= OWN else whole for r in (rows[guess[rows] == k] for k in range(len(names)))], np.float32)
    return model


def _threshold(z: np.ndarray, y: np.ndarray, other: float) -> float:
    """The middle of the widest stretch of margins with the best mean of both classes' recall."""
    if not (y == 1).any() or not (y == 0).any():
        return other
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    right = (np.concatenate([[0], np.cumsum(ys == 0)]) / (ys == 0).sum() + 1 - np.concatenate([[0], np.cumsum(ys == 1)]) / (ys == 1).sum())
    edges = np.concatenate([[zs[0] - 2], zs, [zs[-1] + 2]])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    k = best[np.argmax((edges[1:] - edges[:-1])[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` labelled rows of each class outside the held-out fold."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_y IN (0, 1) AND _id IS NOT NULL").filter(crc_fold("_id", 5) != 0)
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = [rows.filter(F.col("_y") == y).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(min(sample, n)) for y, n in sorted(counts.items())]
    if len(chosen) < 2:
        return None
    ids = [tuple(r) for c in chosen for r in c.select("_id", "_y", "_h").collect()]
    few = docs.sparkSession.createDataFrame(ids, "_id long, _y int, _h long")
    found = docs.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("_id", "_h", "_y", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = found.toArrow().sort_by([("_h", "ascending"), ("_id", "ascending"), ("text", "ascending")]).slice(0, 4 * sample)
    return fit([t or "" for t in found.column("text").to_pylist()], found.column("_y").to_numpy(), found.column("lang").to_pylist())


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row; only the text is read."""

    def run(batches):
        for b in chunks(batches, "text"):
            s = np.zeros(b.num_rows) if model is None else model.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
