"""Language-model scores by a hashed maximum-entropy model.

Counting. Tasks turn texts into 64-bit word hashes and keep, for runs of about RUN tokens, the token sequence and
the sorted distinct hashes with their training counts. Hash ranges are dealt out; each range sums the counts of all
runs and answers every run in its own order, so counts travel as packed arrays and no word is a row.

Vocabulary. Every word of the corpus has a place: a word that makes up a HEAD-th of the training tokens or more (so
at most HEAD words) is a symbol of its own, and the others are dealt by hash to tail classes, about the square root of the
training tokens in number, which are symbols too. Inside a tail class a word has its share by counts plus one, and one
more share is for words that were never seen. So words, classes and features all grow with the corpus.

Model. The symbols are the leaves of a tree of classes (by Huffman's rule, so frequent symbols have short paths). P(word |
history) is the product, over the classes on its path, of a two-way softmax between a class's halves, and the share in
the tail class. Each softmax sums a bias of the class, from counts, and hashed weights of (class, previous word), (class,
word before that: the skip feature) and (class, both), in a table of 2 ** bits weights: about a WEIGHT_SHARE-th of the training
tokens, 2 ** LEAST_BITS at least and 2 ** MOST_BITS at most, which bounds a task's memory.

Training. In each round every task sums, over its training tokens, the gradient and the curvature of the log-likelihood
at the common weights; Spark adds them up by blocks of weights, and one damped diagonal Newton step follows. Sums over all
tokens do not depend on how rows are dealt out, so neither do scores, but for rounding.

Runs hold whole texts, so a batch's memory is bounded by RUN tokens or one text.

Defined results: null or empty text is its end token; a null doc_id counts as training; repeated rows count as
often as they occur; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, Words, chunks, crc_fold, mix, table, utf8

RUN, RANGE_BYTES = 1_200_000, 32 << 20
HEAD, WEIGHT_SHARE, LEAST_BITS, MOST_BITS = 1 << 16, 32, 20, 24
#: A second round would bring 0.04 log10 a token more at sf0.1, for another pass.
ROUNDS, RATE, RIDGE, BATCH = 1, 0.7, 12.0, 1 << 15
END_HASH = np.uint64(0x0E4D0E4D0E4D0E4D)

_U = np.uint64
_RUN = "run long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, hashes binary, counts binary"
_RUN_SCHEMA = pa.schema([("run", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _runs(batches):
    task, made = TaskContext.get().partitionId(), 0
    held, ids, sizes, hashes = [], [], [], []

    def run():
        nonlocal made
        h = np.concatenate(hashes)
        n = np.concatenate(sizes)
        distinct, tokens = np.unique(h, return_inverse=True)
        train = np.repeat(~np.array(held, bool), n)
        counts = np.bincount(tokens[train], minlength=len(distinct)).astype(np.uint32)
        made += 1
        out = pa.RecordBatch.from_pydict({"run": [(task << 32) + made], "doc_ids": [ids], "held": [held], "sizes": [n.astype(np.uint32).tobytes()], "tokens": [tokens.astype(np.uint32).tobytes()], "hashes": [distinct.tobytes()], "counts": [counts.tobytes()]}, schema=_RUN_SCHEMA)
        return out

    total = 0
    for b in chunks(batches, "text"):
        w = Words(*utf8(b.column(2)), LOWER)
        n = w.count + 1
        h = np.empty(len(w.hash) + len(n), _U)
        last = np.cumsum(n) - 1
        inner = np.ones(len(h), bool)
        inner[last] = False
        h[inner] = w.hash
        h[last] = END_HASH
        if total and total + len(h) > RUN:
            yield run()
            held, ids, sizes, hashes, total = [], [], [], [], 0
        ids += b.column(0).to_pylist()
        held += b.column(1).to_pylist()
        sizes.append(n)
        hashes.append(h)
        total += len(h)
    if total:
        yield run()


def _asked(ranges: int):
    """Each run's slices of the hash ranges."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column(1)[i].as_buffer(), _U)
                c = np.frombuffer(b.column(2)[i].as_buffer(), np.uint32)
                cut = np.searchsorted(((h >> _U(32)) * _U(ranges)) >> _U(32), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "run": pa.array([b.column(0)[i].as_py()] * len(some), pa.int64()), "hashes": pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()), "counts": pa.array([c[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())})

    return run


_ANSWER = "part int, run long, counts binary, distinct long, top_hash array<long>, top_count array<long>, class array<long>, class_count array<long>, class_words array<long>"
_ANSWER_SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("counts", pa.binary()), ("distinct", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("top_hash", "top_count", "class", "class_count", "class_words")]])


def class_bits(n: int) -> int:
    """The tail has 2 ** class_bits classes."""
    return max(4, n.bit_length() // 2 - 1)


def tail_class(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h + _U(0x632BE5AB)) >> _U(64 - bits)).astype(np.int64)


def _answered(least: int, bits: int):
    """The corpus counts of each run's words in one range; which are frequent; the tail classes' words and counts there."""

    def run(key, group):
        part, runs = key[0].as_py(), group.column("run").to_pylist()
        hashes = [np.frombuffer(x.as_buffer(), _U) for x in group.column("hashes")]
        word, at = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("counts")]).astype(np.float64)).astype(np.int64)
        hot, tail = c >= least, (c > 0) & (c < least)
        name, of = np.unique(tail_class(word[tail], bits), return_inverse=True)
        rows = {"part": [part], "run": [-1], "counts": [None], "distinct": [int((c > 0).sum())], "top_hash": [word[hot].view(np.int64).tolist()], "top_count": [c[hot].tolist()], "class": [name.tolist()], "class_count": [np.bincount(of, c[tail], len(name)).astype(np.int64).tolist()], "class_words": [np.bincount(of, minlength=len(name)).tolist()]}
        lo = 0
        for r, own in zip(runs, hashes, strict=True):
            mine = at[lo : lo + len(own)]
            lo += len(own)
            for col, v in zip(rows, (part, r, c[mine].tobytes(), *[None] * 6), strict=True):
                rows[col].append(v)
        return pa.Table.from_pydict(rows, schema=_ANSWER_SCHEMA)

    return run


_TOLD = "doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, symbols binary, known binary, logs binary, shares binary, run long"
_TOLD_SCHEMA = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *[(n, pa.binary()) for n in ("sizes", "tokens", "words", "symbols", "known", "logs", "shares")], ("run", pa.int64())])


def _told(head: np.ndarray, bits: int, mass: np.ndarray):
    """A run with the symbols of its words, each text's sums of log10(count + 1), and of log10 shares in tail classes.
    head: sorted hashes of the frequent words; mass: counts, words and one of each tail class."""

    def run(key, group):
        parts, own = [], None
        for r in group.to_pylist():
            if r["tokens"] is not None:
                own = r
            else:
                parts.append(r)
        parts.sort(key=lambda r: r["part"])
        tokens, sizes = np.frombuffer(own["tokens"], np.uint32), np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
        h = np.frombuffer(own["hashes"], _U)
        c = np.concatenate([np.frombuffer(p["counts"], np.int64) for p in parts])
        group_of = tail_class(h, bits)
        symbols = len(head) + group_of
        share = np.log10((c + 1.0) / mass[group_of])
        if len(head):
            k = np.minimum(np.searchsorted(head, h), len(head) - 1)
            hot = head[k] == h
            symbols[hot], share[hot] = k[hot], 0.0
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        per_text = lambda x: np.add.reduceat(x[tokens], first).tobytes()
        cols = {"doc_ids": [own["doc_ids"]], "held": [own["held"]], "sizes": [own["sizes"]], "tokens": [own["tokens"]], "words": [(mix(h) >> _U(32)).astype(np.uint32).tobytes()], "symbols": [symbols.astype(np.uint32).tobytes()], "known": [per_text((c > 0).astype(np.int64))], "logs": [per_text(np.log10(c + 1.0))], "shares": [per_text(share)], "run": [own["run"]]}
        return pa.Table.from_pydict(cols, schema=_TOLD_SCHEMA)

    return run


class MaxEnt:
    """The tree of classes over the symbols and the hashed weights."""

    def __init__(self, masses: np.ndarray, bits: int):
        """masses: the training tokens that each symbol stands for, all above 0."""
        n = len(masses)
        heap = [(float(m), i) for i, m in enumerate(masses)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
        self.bias = np.zeros(max(n - 1, 1), np.float32)
        for k in range(n, 2 * n - 1):  # node k joins the two lightest
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = k
            side[j] = 1
            self.bias[k - n] = math.log(b / a)
            heapq.heappush(heap, (a + b, k))
        depth = np.zeros(2 * n, np.int64)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        self.length = depth[:n] if n > 1 else np.zeros(n, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.node, self.side = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.int8)
        at, place = np.arange(n), self.start + self.length - 1
        while True:  # all paths climb together
            open_ = place >= self.start
            if not open_.any():
                break
            self.node[place[open_]], self.side[place[open_]] = up[at[open_]] - n, side[at[open_]]
            at, place = up[at], place - 1
        self.bits, self.weights = bits, np.zeros(1 << bits, np.float32)

    @staticmethod
    def contexts(words: np.ndarray, first: np.ndarray):
        """Keys of the previous word, of the one before and of both, for every token; texts begin with END."""
        n = len(words)
        end = mix(np.array([END_HASH]))[0] >> _U(32)
        begin = np.zeros(n, np.int64)
        begin[first] = first
        place = np.arange(n) - np.maximum.accumulate(begin)
        w = words.astype(_U)
        one, two = np.full(n, end), np.full(n, end)
        one[1:], two[2:] = w[:-1], w[:-2]
        one[place < 1], two[place < 2] = end, end
        return mix(one + _U(0x1D8E4E27)), mix(two + (_U(1) << _U(40))), mix(one * _U(0x9E3779B97F4A7C15) ^ (two + (_U(1) << _U(50))))

    def decisions(self, symbols, keys):
        """The steps of a batch of tokens: token, side taken (0 or 1), places of the three weights, and the sum."""
        length = self.length[symbols]
        token = np.repeat(np.arange(len(symbols)), length)
        step = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.start[symbols], length)
        node = self.node[step]
        salt = node.astype(_U) * _U(0xD6E8FEB86659FD93)
        at = [((k[token] ^ salt) * _U(0xFF51AFD7ED558CCD) >> _U(64 - self.bits)).astype(np.int64) for k in keys]
        z = self.bias[node]
        for i in at:
            z = z + self.weights[i]
        return token, self.side[step], at, z

    def log10(self, symbols: np.ndarray, keys) -> np.ndarray:
        """log10 probability of each token's symbol."""
        out = np.zeros(len(symbols))
        for lo in range(0, len(symbols), BATCH):
            part = slice(lo, lo + BATCH)
            token, side, _, z = self.decisions(symbols[part], [k[part] for k in keys])
            z = np.where(side == 1, -z, z)
            out[part] = -np.bincount(token, np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))), len(out[part])) / math.log(10)
        return out

    def add(self, symbols, keys, slope: np.ndarray, bend: np.ndarray) -> None:
        """Adds the tokens' gradient and curvature."""
        for lo in range(0, len(symbols), BATCH):
            part = slice(lo, lo + BATCH)
            _, side, at, z = self.decisions(symbols[part], [k[part] for k in keys])
            p = 1 / (1 + np.exp(-z))
            g, h = (side - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
            for i in at:
                np.add.at(slope, i, g)
                np.add.at(bend, i, h)

    def step(self, slope: np.ndarray, bend: np.ndarray, at: slice) -> None:
        self.weights[at] += (RATE * slope / (bend + RIDGE)).astype(np.float32)


def _sequence(r: dict):
    """Symbols, context keys and text bounds of a run."""
    sizes = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
    tokens = np.frombuffer(r["tokens"], np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.frombuffer(r["symbols"], np.uint32)[tokens].astype(np.int64), MaxEnt.contexts(np.frombuffer(r["words"], np.uint32)[tokens], first), sizes, first


_SUMS, _BLOCK = "low long, task long, slope binary, bend binary", 1 << 16


def _slopes(model: MaxEnt):
    """Gradient and curvature over a task's training tokens, in blocks of weights."""

    def run(batches):
        slope, bend = np.zeros(len(model.weights), np.float32), np.zeros(len(model.weights), np.float32)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                symbols, keys, sizes, _ = _sequence(r)
                own = np.repeat(~np.array(r["held"], bool), sizes)
                model.add(symbols[own], [k[own] for k in keys], slope, bend)
        task = TaskContext.get().partitionId()
        for lo in range(0, len(slope), _BLOCK):
            part = slice(lo, lo + _BLOCK)
            if bend[part].any():
                yield pa.RecordBatch.from_pydict({"low": pa.array([lo], pa.int64()), "task": pa.array([task], pa.int64()), "slope": pa.array([slope[part].tobytes()], pa.binary()), "bend": pa.array([bend[part].tobytes()], pa.binary())})

    return run


def _summed(key, group):
    """Sums of a block."""
    total = [sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in group.column(c)) for c in ("slope", "bend")]
    return pa.Table.from_pydict({"low": pa.array([key[0].as_py()], pa.int64()), "task": pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int64()), **{c: [t.astype(np.float32).tobytes()] for c, t in zip(("slope", "bend"), total, strict=True)}})


def train(told: DataFrame, model: MaxEnt, size: int) -> MaxEnt:
    """The trained model. size: bytes of the texts; so many tasks that what they send stays below about half of that."""
    tasks = max(8, size // (16 * len(model.weights)))
    told, salts = told.coalesce(tasks), -(-tasks // 256)
    for _ in range(ROUNDS):
        sums = told.select("held", "sizes", "tokens", "words", "symbols").mapInArrow(_slopes(model), _SUMS)
        if salts > 1:  # no task adds up more than some hundred sums of a block
            sums = sums.withColumn("task", F.pmod("task", F.lit(salts))).groupBy("low", "task").applyInArrow(_summed, _SUMS)
        for r in sums.groupBy("low").applyInArrow(_summed, _SUMS).toLocalIterator():
            model.step(np.frombuffer(bytes(r["slope"]), np.float32), np.frombuffer(bytes(r["bend"]), np.float32), slice(r["low"], r["low"] + _BLOCK))
    return model


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: MaxEnt, n: int, v: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                symbols, keys, sizes, first = _sequence(r)
                score = np.add.reduceat(model.log10(symbols, keys), first) + np.frombuffer(r["shares"], np.float64)
                base = np.frombuffer(r["logs"], np.float64) - sizes * np.log10(n + v + 1.0)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r["doc_ids"], pa.int64()), "held_out": pa.array(r["held"], pa.bool_()), "n_tokens": pa.array(sizes), "n_known": pa.array(np.frombuffer(r["known"], np.int64)), "train_tokens": pa.array(np.full(len(sizes), n)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def scored(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every document; held_out: a boolean column of those that nothing is learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, min(1 << 22, size // RANGE_BYTES))
    with Scratch(docs.sparkSession, "lm") as scratch:
        runs = scratch.stored(rows.mapInArrow(_runs, _RUN), "runs")
        n = _training_tokens(runs)
        bits = class_bits(n)
        asked = runs.select("run", "hashes", "counts").mapInArrow(_asked(ranges), "part int, run long, hashes binary, counts binary")
        answers = scratch.stored(asked.groupBy("part").applyInArrow(_answered(max(2, -(-n // HEAD)), bits), _ANSWER), "answers")
        totals = answers.filter("run = -1")
        v = totals.agg(F.sum("distinct")).first()[0] or 0
        top = totals.select(F.explode(F.arrays_zip("top_hash", "top_count")).alias("t")).select("t.top_hash", "t.top_count").toArrow()
        order = np.argsort(top.column(0).to_numpy().view(_U))
        head, head_count = top.column(0).to_numpy().view(_U)[order], top.column(1).to_numpy()[order]
        tail = totals.select(F.explode(F.arrays_zip("class", "class_count", "class_words")).alias("t")).groupBy("t.class").agg(F.sum("t.class_count").alias("c"), F.sum("t.class_words").alias("w")).toArrow()
        mass = np.ones(1 << bits)
        mass[tail.column(0).to_numpy()] += tail.column(1).to_numpy() + tail.column(2).to_numpy()
        own = runs.select("run", F.lit(None).cast("int").alias("part"), "doc_ids", "held", "sizes", "tokens", "hashes", F.lit(None).cast("binary").alias("counts"))
        replies = answers.filter("run <> -1").select("run", "part", F.lit(None).cast("array<bigint>").alias("doc_ids"), F.lit(None).cast("array<boolean>").alias("held"), *[F.lit(None).cast("binary").alias(c) for c in ("sizes", "tokens", "hashes")], "counts")
        told = scratch.stored(own.unionByName(replies).groupBy("run").applyInArrow(_told(head, bits, mass), _TOLD), "symbols")
        scratch.drop("runs", "answers")
        weight_bits = min(MOST_BITS, max(LEAST_BITS, (n // WEIGHT_SHARE).bit_length() - 1))
        model = train(told, MaxEnt(np.concatenate([head_count, mass]), weight_bits), size)
        found = told.select("doc_ids", "held", "sizes", "tokens", "words", "symbols", "known", "logs", "shares").mapInArrow(_scored(model, int(n), int(v)), _SCORE)
        return scratch.result(found, "scores")


def _training_tokens(runs: DataFrame) -> int:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.frombuffer(x.as_buffer(), np.uint32).sum(dtype=np.int64)) for x in b.column(0)], pa.int64())})

    return runs.select("counts").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def op8_lm(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_fold("doc_id", 7) == 2)
