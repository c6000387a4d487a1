"""Jaccard self join of word shingle sets by parity sketches.

Sets: distinct 5-word shingles as 52-bit hashes. Equal sets (size and two 64-bit sums) are one class, and only
classes are joined. Two sets with Jaccard >= s differ in at most D = (1-s)/(1+s) * (|A|+|B|) elements.

Candidates: the hash range is cut into m > D parts, and the elements of a part are XOR-ed into one word. An element
that only one of two sets has changes one part, so of two sets within D at least m - D parts are equal: an
equi-join on (namespace, part, word) finds every pair. m and D are fixed per size band (sizes up to twice each
other) and once more across each border of bands. Equal empty parts tell nothing; m is so large that two sets share
`surplus(D) + 1` filled parts at least. A set with fewer filled parts than that takes part in a second namespace as
well, and, if still too few are filled (very small sets), in a third by its single elements.
Elements that are frequent in a bounded sample are left out of the first namespaces: leaving a fixed set out
of all sketches only shrinks differences, so no pair is lost, and shared passages make no large groups.

Keys are rows (key, set), never lists; keys of one set only are dropped in a stream. As a pair shares t keys of a
namespace or more, a set with k shared keys needs only the k - t + 1 rarest of them, and none if k < t. Pairs come from
  1. keys of up to FEW sets: their pairs;
  2. larger keys: each set against one hub, the member that shares most with others, in HUB_ROUNDS rounds. Links become
     components, and keys whose sets are of one component are done;
  3. what is left of the larger keys (counts and prefixes of keys are taken anew over these keys alone, as a pair not yet
     seen has all its common keys there). Their sets may share a passage without being similar, so a key is not paired out:
     of two similar sets the smaller has one of its n - 2s/(1+s) n + 1 rarest shingles among the larger's n - s n + 1
     rarest, whatever order "rare" is; it is by the number of these sets that have a shingle. Sets with a passage in common and
     their own text beside it have their own shingles there, and meet nobody. In CHAIN_ROUNDS turns each set meets the next one of
     its shingle, so a group of similar sets becomes one component by a chain; then, of each shingle, the sets of its largest
     component meet only the others, all of them. Sizes and parity sketches, also ones of WIDE words, are compared inside the
     join, so only possible pairs are rows: sets that share most of a text, but not enough, seldom are.
256-bit parity sketches (each element flips one bit; the Hamming distance is at most the difference of the sets) drop
most pairs, and the texts of the rest are compared exactly.

Defined results: null or wordless text has an empty set and links with nothing (its component is its own doc_id);
fewer than five words are one shingle; rows that repeat a doc_id are one node, whose links are those of any of its
texts; an empty table gives an empty table; further columns are ignored (one_of_each keeps them, whatever their names).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, Scratch, Words, chunks, grams, mix, table, utf8
from .graph import components

WORDS, PERCENT = 5, 80
#: Documents whose shingles tell which are frequent, and in how many of them a frequent one is at least.
SAMPLE, FREQUENT = 20_000, 8
#: Turns in which keys are made and shuffled, each a share of all of them: most keys have one set and are dropped after the shuffle,
#: which is the largest, so only a share of it is on disk at once.
KEY_TURNS = 2
#: Keys of up to FEW sets list their pairs; sets of larger ones are tested against a hub HUB_ROUNDS times.
FEW, HUB_ROUNDS = 8, 2
#: Turns in which sets that share a rare shingle are tested in chains, before all their pairs are made.
CHAIN_ROUNDS = 2
#: Words of the parity sketches of sets that are compared by rare shingles.
WIDE = 64
#: Pairs with both texts that go to Python at once.
PAIR_ROWS = 256
_U = np.uint64
_BITS, _MASK = 52, np.uint64((1 << 52) - 1)
_DOCS, _FLUSH = 4000, 1_000_000
#: The lowest bits of a key tell its namespace: own band, border, the same of sets with few rare parts, single elements.
_KINDS = 6


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of up to _DOCS texts, their texts, and where each text's begin."""
    w = Words(*utf8(col), LOWER)
    g = grams(w.hash, WORDS)
    whole = w.doc[: len(g)] == w.doc[WORDS - 1 :][: len(g)]
    value, doc = [g[whole]], [w.doc[: len(g)][whole]]
    for n in range(1, WORDS):  # the whole sequence of a short text; its length tells it from others
        at = w.first[:-1][w.count == n]
        if len(at):
            h = w.hash[at]
            for k in range(1, n):
                h = mix(h) * _U(3) + w.hash[at + k]
            value.append(mix(h + np.full(len(h), n, _U) * _U(0x9FB21C651E98DF25)))
            doc.append(np.flatnonzero(w.count == n))
    both = (np.concatenate(doc).astype(_U) << _U(_BITS)) | (np.concatenate(value) >> _U(64 - _BITS))
    both.sort()
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    doc = (both >> _U(_BITS)).astype(np.int64)
    return both & _MASK, doc, np.searchsorted(doc, np.arange(len(col) + 1))


def small(batches):
    """Chunks of at most _DOCS rows."""
    for b in chunks(batches):
        for lo in range(0, b.num_rows, _DOCS):
            yield b.slice(lo, _DOCS)


def _sums(x: np.ndarray, first: np.ndarray, ufunc=np.add) -> np.ndarray:
    out = np.zeros(len(first) - 1, _U)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = ufunc.reduceat(x, first[:-1][some])
    return out


_SET = "doc_id long, n long, d1 long, d2 long, s0 long, s1 long, s2 long, s3 long, t_own long, t_near long"


def _sets(percent: int):
    """doc_id, size, two sums that identify the set, its 256-bit parity sketch, and the keys that it shares at least with
    a similar set in the namespaces of its band and of the border near."""

    def run(batches):
        for b in small(batches):
            v, doc, first = shingles(b.column(1))
            h = mix(v + _U(0x51ED270B))
            bit = np.zeros((4, len(v)), _U)
            bit[((h >> _U(6)) & _U(3)).astype(np.int64), np.arange(len(v))] = _U(1) << (h & _U(63))
            cols = [_sums(h, first), _sums(mix(h ^ _U(0xA5A5A5A5)), first), *[_sums(bit[k], first, np.bitwise_xor) for k in range(4)]]
            _, own, _, near = namespaces(np.diff(first), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), *[pa.array(c.view(np.int64)) for c in cols], pa.array(surplus(own) + 1), pa.array(surplus(near) + 1)], names=["doc_id", "n", "d1", "d2", "s0", "s1", "s2", "s3", "t_own", "t_near"])

    return run


def difference(total, percent: int = PERCENT):
    """The most elements in which two sets of `total` elements together may differ."""
    return total * (100 - percent) // (100 + percent)


def namespaces(sizes: np.ndarray, percent: int = PERCENT):
    """For each set: (namespace, D) of its band, and of the border of bands it is near, or -1."""
    band = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    own = difference(2 * ((2 << band) - 1), percent)
    # a pair across the border 2**k has its smaller set at s * 2**k at least and its larger at 2**k / s at most
    near = np.full(len(sizes), -1)
    d = np.zeros(len(sizes), np.int64)
    for k in (band, band + 1):
        edge = 1 << k
        inside = (100 * sizes >= percent * edge) & (percent * sizes <= 100 * edge) & (k > 0)
        near[inside] = k[inside]
        most = (100 * edge) // percent
        d[inside] = difference(edge - 1 + most, percent)[inside]
    return band, own, near, d


def surplus(most):
    """Equal filled parts, beyond the one that the bound promises, that a set must promise its partners to need no
    second namespace. More of them make m larger and candidates fewer."""
    return most // 8


def of_kind(word: np.ndarray, name: np.ndarray, kind: int) -> np.ndarray:
    """Keys of a namespace."""
    key = mix(word + (name + 64 * kind).astype(_U) * _U(0x9E3779B97F4A7C15))
    return (key & ~_U(7)) | _U(kind)


def parts(v, doc, first, which, name, most, kind):
    """Keys of the filled parts of the sets `which` (name and D by set), their sets, and how many each has."""
    m = np.where(most == 0, 1, most + surplus(most) + most // 16 + 4)
    chosen = which[doc]
    v, doc = v[chosen], doc[chosen]
    part = ((v >> _U(20)) * m[doc].astype(_U)) >> _U(32)
    if not len(v):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(first) - 1, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]))
    word = np.bitwise_xor.reduceat(mix(v + _U(0x2545F491)), begin)
    owner = doc[begin]
    return of_kind(word + part[begin] * _U(0xC2B2AE3D27D4EB4F), name[owner], kind), owner, np.bincount(owner, minlength=len(first) - 1)


def _keys(frequent: np.ndarray, percent: int, turn: int = 0, turns: int = 1):
    """(key, d1) of every set, of the keys of one turn; a set that the task has met lately is left out, as its rows are there already."""

    def run(batches):
        seen: set[int] = set()
        for b in small(batches):
            v, doc, first = shingles(b.column(0))
            n = np.diff(first)
            d1 = _sums(mix(v + _U(0x51ED270B)), first)
            ident = mix(d1 + n.astype(_U))
            fresh = n > 0
            for i, x in enumerate(ident.tolist()):
                if fresh[i]:
                    fresh[i] = x not in seen
                    seen.add(x)
            if len(seen) > 2_000_000:
                seen.clear()
            rare = np.ones(len(v), bool)
            if len(frequent) and len(v):
                rare = frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] != v
            band, own, near, d = namespaces(n, percent)
            # no partner of a set differs from it in more than this
            least = difference(n + 100 * n // percent, percent)
            keys, owners = [], []
            for kind, (name, most, which) in enumerate(((band, own, fresh), (near, d, fresh & (near >= 0)))):
                k, o, filled = parts(v[rare], doc[rare], first, which, name, most, kind)
                keys.append(k)
                owners.append(o)
                enough = np.minimum(least, most) + surplus(most)
                poor = which & (filled <= enough)
                if poor.any():
                    k, o, filled = parts(v, doc, first, poor, name, most, 2 + kind)
                    keys.append(k)
                    owners.append(o)
                    last = poor & (filled <= enough)
                    if last.any():
                        single = last[doc]
                        keys.append(of_kind(v[single], name[doc[single]], 4 + kind))
                        owners.append(doc[single])
            key, owner = np.concatenate(keys), np.concatenate(owners)
            own = (key >> _U(3)) % _U(turns) == _U(turn)
            yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(d1[owner[own]].view(np.int64))], names=["key", "d1"])

    return run


def _split(key, d1):
    """Sorted distinct (key, d1) of keys with two sets or more, and the one set of each other key."""
    order = np.argsort(key)
    key, d1 = key[order], d1[order]
    again = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    again[1:] |= same
    again[:-1] |= same
    lone = ~again
    one_key, one_d1 = key[lone], d1[lone]
    key, d1 = key[again], d1[again]
    order = np.lexsort((d1, key))
    key, d1 = key[order], d1[order]
    if not len(key):
        return key, d1, one_key, one_d1
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    fresh = new_key | np.concatenate([[True], d1[1:] != d1[:-1]])
    key, d1, new_key = key[fresh], d1[fresh], new_key[fresh]
    lone = new_key & np.append(new_key[1:], True)
    return key[~lone], d1[~lone], np.concatenate([one_key, key[lone]]), np.concatenate([one_d1, d1[lone]])


def _shared(batches):
    """Rows (key, d1) whose key has two sets or more. Rows wait only while their key has one set, and once a key has had two
    its further rows pass, so memory follows the different keys of a partition, not the rows of a hot one. A row may
    come twice from a partition of more than _FLUSH rows, which does no harm."""
    passing = np.zeros(0, np.int64)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        nonlocal passing, held, waiting
        key, d1 = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.int64),) * 2
        waiting = []
        through = np.zeros(len(key), bool)
        if len(passing):
            through = passing[np.minimum(np.searchsorted(passing, key), len(passing) - 1)] == key
        out_key, out_d1, *held = _split(np.concatenate([held[0], key[~through]]), np.concatenate([held[1], d1[~through]]))
        passing = np.union1d(passing, out_key)
        out_key, out_d1 = np.concatenate([out_key, key[through]]), np.concatenate([out_d1, d1[through]])
        for lo in range(0, len(out_key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(out_key[lo : lo + 100_000]), pa.array(out_d1[lo : lo + 100_000])], names=["key", "d1"])

    rows = 0
    for b in batches:
        waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        rows += b.num_rows
        if rows >= _FLUSH:
            yield from flush()
            rows = 0
    yield from flush()


def _frequencies(batches):
    for b in small(batches):
        v, _, _ = shingles(b.column(1))
        value, count = np.unique(v, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["v", "n"])


def frequent_shingles(texts: DataFrame, rows: int) -> np.ndarray:
    """Shingles that are in FREQUENT or more of about SAMPLE documents; sorted. At most a FREQUENT-th of the
    sample's shingles, whatever the corpus."""
    some = texts if rows <= SAMPLE else texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / rows) + 1)
    got = some.mapInArrow(_frequencies, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).select("v").toArrow()
    return np.sort(got.column(0).to_numpy().view(np.uint64))


def _bitmap(key, group):
    """The bits of one block of the filter."""
    bits = np.zeros(_BLOCK_BITS, bool)
    bits[group.column("bit").to_numpy() % _BLOCK_BITS] = True
    return pa.Table.from_pydict({"block": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(bits).tobytes()]})


_BLOCK_BITS, _MOST_BITS = 1 << 16, 1 << 26


def _members(bits: np.ndarray):
    """The texts, compressed, of documents whose bit is set."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches):
            at = b.column(2).to_numpy()
            b = b.filter(pa.array(_is_set(bits, at)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packer.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "members"])

    return run


def _runs(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most `most` bytes together, one row at least."""
    total, out, at = np.cumsum(size), [], 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        out.append((at, end))
        at = end
    return out


def _verified(percent: int):
    def run(batches):
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            size = np.array([zstandard.frame_content_size(x.as_buffer()) for c in (2, 3) for x in b.column(c)], np.int64).reshape(2, -1).max(0)
            for lo, end in _runs(size, CHUNK_BYTES):
                part = b.slice(lo, end - lo)
                sides = []
                for c in (2, 3):
                    texts = pa.array([reader.decompress(x.as_buffer()).decode() for x in part.column(c)], pa.string())
                    v, _, first = shingles(texts)
                    sides.append([v[s:e] for s, e in zip(first[:-1], first[1:], strict=True)])
                keep = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(*sides, strict=True)):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = len(both) > 0 and 100 * common >= percent * (len(both) - common)
                yield part.select([0, 1]).filter(pa.array(keep))

    return run


def _place(column, size: int):
    """The bit of an id in a bitmap of `size` bits."""
    return F.pmod(F.xxhash64(column, F.lit(9)), F.lit(size))


def bitmap(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashed ids nodes (id), of at most 8 MB whatever the corpus, and its bits."""
    size, count = _BLOCK_BITS, nodes.count()
    while size < min(_MOST_BITS, 16 * count):
        size *= 4
    blocks = nodes.select(_place("id", size).alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / _BLOCK_BITS).cast("long")).groupBy("block").applyInArrow(_bitmap, "block long, bits binary").collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in blocks:
        bits[r["block"] * _BLOCK_BITS // 8 : (r["block"] + 1) * _BLOCK_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits, size


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def packed_texts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, members): the compressed texts of the documents nodes (id). They are picked in the scan by a bitmap; a wrong pick is
    dropped by later joins."""
    bits, size = bitmap(nodes)
    return texts.filter("doc_id IS NOT NULL").select("doc_id", "text", _place("doc_id", size).alias("bit")).mapInArrow(_members(bits), "doc_id long, members binary")


def verified(pairs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of doc_ids those of which some texts' sets are similar."""
    one = members.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    two = members.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_verified(percent), "a long, b long")


def _alike(percent: int, a: str, b: str, wide: bool = False):
    """The condition that sizes and parity sketches of two sets, the wide ones after the short, leave them possibly similar."""
    flips = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(4)), F.lit(0))
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    few = lambda x: x * (100 + percent) <= (low + high) * (100 - percent)
    alike = (100 * low >= percent * high) & few(flips)
    if wide:
        both = F.zip_with(f"{a}.w", f"{b}.w", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        alike = alike & few(F.aggregate(both, F.lit(0), lambda n, x: n + x))
    return alike


def likely(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of class representatives those that sizes and parity sketches leave possible."""
    info = classes.select("rep", "n", "s0", "s1", "s2", "s3")
    pairs = pairs.join(info.alias("p"), F.col("a") == F.col("p.rep")).join(info.alias("q"), F.col("b") == F.col("q.rep"))
    return pairs.filter(_alike(percent, "p", "q")).select("a", "b")


def sized(keys: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """keys (key, d1) with each key's size, each set's representative and t, the fewest keys of the namespace that a
    similar pair shares."""
    size = keys.groupBy("key").agg(F.count("*").alias("size"))
    kind = F.col("key").bitwiseAND(F.lit(7))
    t = F.when(kind >= 4, F.ceil(F.col("n") * percent / 100)).when(kind.bitwiseAND(F.lit(1)) == 0, F.col("t_own")).otherwise(F.col("t_near"))
    return keys.join(size, "key").join(classes.select("d1", "n", "rep", "t_own", "t_near"), "d1").select("d1", "rep", "key", "size", kind.alias("kind"), t.alias("t"))


def rarest(keys: DataFrame) -> DataFrame:
    """Of every set and namespace with k keys the k - t + 1 rarest, of which a similar set has one at least."""
    of_set = Window.partitionBy("d1", "rep", "kind")
    rows = keys.withColumn("k", F.count("*").over(of_set)).filter("k >= t")
    return rows.withColumn("rank", F.row_number().over(of_set.orderBy("size", "key"))).filter("rank <= k - t + 1").select(*keys.columns)


def _elements(batches):
    """The shingles of compressed texts, a row each: rep, d1, n, e."""
    reader = zstandard.ZstdDecompressor()
    for b in batches:
        size = np.array([zstandard.frame_content_size(x.as_buffer()) for x in b.column(1)], np.int64)
        for lo, end in _runs(size, CHUNK_BYTES):
            part = b.slice(lo, end - lo)
            v, doc, first = shingles(pa.array([reader.decompress(x.as_buffer()).decode() for x in part.column(1)], pa.string()))
            d1 = _sums(mix(v + _U(0x51ED270B)), first).view(np.int64)
            rep = part.column(0).to_numpy()
            for at in range(0, len(v), 100_000):
                d = doc[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(rep[d]), pa.array(d1[d]), pa.array(np.diff(first)[d]), pa.array(v[at : at + 100_000].view(np.int64))], names=["rep", "d1", "n", "e"])


def _wide(batches):
    """Parity sketches of WIDE words of the sets of compressed texts: rep, d1, w."""
    reader = zstandard.ZstdDecompressor()
    for b in batches:
        size = np.array([zstandard.frame_content_size(x.as_buffer()) for x in b.column(1)], np.int64)
        for lo, end in _runs(size, CHUNK_BYTES):
            part = b.slice(lo, end - lo)
            v, doc, first = shingles(pa.array([reader.decompress(x.as_buffer()).decode() for x in part.column(1)], pa.string()))
            h = mix(v + _U(0x51ED270B))
            words = np.zeros((part.num_rows, WIDE), _U)
            np.bitwise_xor.at(words, (doc, ((h >> _U(6)) % _U(WIDE)).astype(np.int64)), _U(1) << (h & _U(63)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, WIDE * part.num_rows + 1, WIDE, dtype=np.int32)), pa.array(words.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sums(h, first).view(np.int64)), lists], names=["rep", "d1", "w"])


def rare_rows(sets: DataFrame, members: DataFrame, stored, parts: int, percent: int = PERCENT) -> DataFrame:
    """The rarest shingles of sets (rep, d1, n, s0 to s3): e, whether it is one of those of which a similar larger set has one, and
    the set with its wide sketch."""
    texts = members.join(sets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "members")
    rows = texts.mapInArrow(_elements, "rep long, d1 long, n long, e long").join(sets.select("rep", "d1"), ["rep", "d1"], "left_semi").distinct()
    rows = stored(rows, "elements")
    count = rows.groupBy("e").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep", "d1").orderBy("df", "e"))
    ceil = lambda a, b: F.expr(f"({a} + {b} - 1) div ({b})")
    probe, index = F.col("n") - ceil(f"{percent} * n", 100) + 1, F.col("n") - ceil(f"{2 * percent} * n", 100 + percent) + 1
    rows = rows.join(count, "e").withColumn("rank", rank).filter((F.col("rank") <= probe) & (F.col("df") > 1)).select("e", "rep", "d1", (F.col("rank") <= index).alias("index"))
    wide = texts.mapInArrow(_wide, "rep long, d1 long, w array<bigint>").dropDuplicates(["rep", "d1"])
    return stored(rows.join(sets.join(wide, ["rep", "d1"]), ["rep", "d1"]), "prefix", parts)


def open_rows(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the component of each set and the largest component of the shingle, of shingles that several have."""
    rows = rows.join(label, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    by = rows.groupBy("e", "component").agg(F.count("*").alias("k")).groupBy("e").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count("*").alias("components")).filter("components > 1")
    return rows.join(by.select("e", "major"), "e")


def chained_pairs(rows: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): along each shingle, every set and the next one, if they are of different components and may be similar: no more pairs
    than rows. Sets that are all similar to each other become one component by these, without all their pairs. Sets are
    in the order of their sizes, in later turns in any other."""
    order = ["n", "rep", "d1"] if turn == 0 else [F.xxhash64("rep", "d1", F.lit(turn)), "rep", "d1"]
    one = F.struct("rep", "d1", "n", "component", "s0", "s1", "s2", "s3", "w")
    next_ = rows.select("e", one.alias("p"), F.lead(one).over(Window.partitionBy("e").orderBy(*order)).alias("q"))
    found = next_.filter(F.expr("p.component <> q.component AND p.rep <> q.rep") & _alike(percent, "p", "q", True))
    return found.select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")).distinct()


def rare_pairs(sets: DataFrame, members: DataFrame, stored, parts: int, percent: int = PERCENT, rows: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of sets (rep, d1, n, s0 to s3, component) of different components that may be similar, by their rarest
    shingles; rows: these, if they are there already."""
    if rows is None:
        rows = rare_rows(sets.drop("component"), members, stored, parts, percent)
    rows = open_rows(rows, sets.select(F.col("rep").alias("node"), "component").distinct())
    smaller = F.when(F.expr("struct(p.n, p.rep, p.d1) < struct(q.n, q.rep, q.d1)"), F.col("p.index")).otherwise(F.col("q.index"))
    pairs = rows.filter("component <> major").alias("p").join(rows.alias("q"), F.expr("p.e = q.e AND p.component <> q.component AND p.rep <> q.rep") & smaller & _alike(percent, "p", "q", True))
    return pairs.select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")).distinct()


def open_keys(keys: DataFrame, label: DataFrame | None) -> DataFrame:
    """keys with the component of each set, of keys that hold several components."""
    if label is None:
        return keys.withColumn("component", F.col("rep"))
    named = keys.join(label, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    spread = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return named.join(spread, "key")


def hub_pairs(keys: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Of every open key the two sets of most keys that are in different components are its hubs; each set is paired with
    the hub, of another component and not tested yet, that most of its keys, two at least, name; what that misses is left to
    the last step."""
    weight = keys.join(keys.groupBy("rep").agg(F.count("*").alias("weight")), "rep")
    best = weight.groupBy("key", "component").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("best"), "component"))
    best = best.withColumn("place", place).filter("place <= 2")
    hub = lambda k, c: F.max(F.when(F.col("place") == k, c))
    hubs = best.groupBy("key").agg(hub(1, -F.col("best.minus")).alias("one"), hub(1, F.col("component")).alias("of_one"), hub(2, -F.col("best.minus")).alias("two"))
    rows = keys.join(hubs, "key").select("rep", F.when(F.col("component") == F.col("of_one"), F.col("two")).otherwise(F.col("one")).alias("hub"))
    counts = rows.filter("hub <> rep").groupBy("rep", "hub").agg(F.count("*").alias("times")).filter("times > 1").select("rep", "hub", "times", F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    if tested is not None:
        counts = counts.join(tested, ["a", "b"], "left_anti")
    return counts.groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("times", "hub")).alias("m")).select("m.a", "m.b").distinct()


def similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with Scratch(spark, "jaccard") as scratch:
        stored = scratch.stored
        sets = stored(texts.mapInArrow(_sets(percent), _SET), "sets")
        classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2", "s0", "s1", "s2", "s3", "t_own", "t_near").agg(F.min("doc_id").alias("rep"))
        classes = stored(classes, "classes")
        rows, shingle_rows = sets.agg(F.count("*"), F.sum("n")).first()
        frequent = frequent_shingles(texts, rows)
        deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (shingle_rows or 0) // (2_000_000 * KEY_TURNS))
        known, keys = texts.filter("doc_id IS NOT NULL").select("text"), None
        for turn in range(KEY_TURNS):
            some = known.mapInArrow(_keys(frequent, percent, turn, KEY_TURNS), "key long, d1 long")
            some = stored(some.repartition(deal, "key").mapInArrow(_shared, "key long, d1 long"), "shared")
            keys = some if keys is None else keys.unionByName(some)
        keys = stored(sized(keys, classes, percent), "keys")
        parts = 8 + keys.count() // 50_000  # the most files of a table of keys
        many = keys.filter(F.col("size") > FEW)
        few = stored(rarest(keys).filter(F.col("size") <= FEW).select("key", "rep"), "few", parts)
        members = stored(packed_texts(keys.select(F.col("rep").alias("id")).distinct(), texts).distinct(), "members", parts)

        # rows that repeat a doc_id with other texts are one node
        of_class = classes.select("n", "d1", "d2", "rep")
        reps = sets.filter("n > 0 AND doc_id IS NOT NULL").join(of_class, ["n", "d1", "d2"])
        again = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).filter("a < high").select("doc_id", "a")
        links = reps.join(again, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()

        pairs = few.alias("p").join(few.alias("q"), F.expr("p.key = q.key AND p.rep < q.rep")).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct()
        tested, label = None, None
        for k in range(HUB_ROUNDS + CHAIN_ROUNDS + 1):
            if k <= HUB_ROUNDS:
                at = stored(open_keys(many, label), "open", parts)
            if k == 0:
                pairs = likely(pairs.union(hub_pairs(at, None)).distinct(), classes, percent)
            elif k < HUB_ROUNDS:
                pairs = likely(hub_pairs(at, tested), classes, percent)
            else:
                if k == HUB_ROUNDS:
                    left = sized(at.select("key", "d1").distinct(), classes, percent)
                    left = rarest(left).select("rep", "d1").distinct()
                    left = stored(left.join(classes.select("rep", "d1", "n", "s0", "s1", "s2", "s3"), ["rep", "d1"]), "left", parts)
                    rare = rare_rows(left, members, stored, parts, percent)
                if k < HUB_ROUNDS + CHAIN_ROUNDS:
                    pairs = chained_pairs(open_rows(rare, label), k - HUB_ROUNDS, percent)
                else:
                    named = left.join(label, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
                    pairs = rare_pairs(named, members, stored, parts, percent, rare)
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs", parts)
            tested = pairs if tested is None else tested.unionByName(pairs)
            count = pairs.count()
            if k == 0 or count:
                links = stored(links.unionByName(verified(pairs, members, percent)), "links", 24 + count // 2000, PAIR_ROWS)
                label = components(links, stored)
        named = of_class.join(label, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
        found = sets.join(named, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return scratch.result(found, "found")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each component the document with the smallest doc_id stays, once (of rows that repeat
    it that with the smallest hash); rows without doc_id stay. The columns of docs, whatever their names.

    Most documents stay, and their rows are not shuffled: a bitmap of the others' ids, and of repeated ones, tells in the scan which
    rows need the join at all; a row that it names wrongly is joined and stays."""
    mark = uuid.uuid4().hex
    c, n, i, k = (f"{x}_{mark}" for x in "cnik")
    label = similar(docs, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias(c), F.count("*").alias(n))
    keep = label.filter(F.col("doc_id") == F.col(c)).select(F.col("doc_id").alias(i), n)
    bits, size = bitmap(label.filter((F.col("doc_id") != F.col(c)) | (F.col(n) > 1)).select(F.col("doc_id").alias("id")))
    columns = [F.col(f"`{x}`") for x in docs.columns]
    named = F.arrow_udf(_named(bits), "boolean")(_place(F.col("doc_id").cast("long"), size))
    out = docs.filter(F.col("doc_id").isNull() | ~named)
    rows = docs.filter(F.col("doc_id").isNotNull() & named).join(keep, F.col("doc_id") == F.col(i))
    out = out.unionByName(rows.filter(F.col(n) == 1).select(*columns))
    if keep.filter(F.col(n) > 1).limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*columns))
        again = rows.filter(F.col(n) > 1).withColumn(k, F.row_number().over(order)).filter(F.col(k) == 1)
        out = out.unionByName(again.select(*columns))
    return out


def _named(bits: np.ndarray):
    """Whether bits of a bitmap are set."""

    def run(at: pa.Array) -> pa.Array:
        return pa.array(_is_set(bits, at.to_numpy()))

    return run


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
