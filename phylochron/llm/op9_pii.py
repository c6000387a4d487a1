"""Personal data by bootstrapped contextual extraction.

Seeds are what the base patterns find (e-mail, IP, card with Luhn check, international phone). Each seed induces
lexical patterns: the word before it, the two words before it, the words on both sides, and the characters glued to its
front up to a `=` or `:` in the same word (as in `host=10.0.0.1`). Spark scores the
graph of patterns and instances iteratively: a pattern is worth the share of its occurrences in the whole
corpus that are filled by trusted instances, an instance as much as the best pattern that finds it; seeds are
trusted fully. Words with the shape of an identifier in the place of a high-confidence pattern become spans of
the pattern's kind. Base spans always stay.

Three passes over the texts: seeds and their contexts; occurrences and new instances of the patterns that at
least MIN_SEEDS different seeds share; the spans. To be counted, patterns travel to the tasks as sorted 64-bit hashes in
blocks of at most BLOCK, one pass a block; those that are trusted in the end travel together, 12 bytes each. An instance has
the shape of its kind and SHORTEST characters at least, as shorter words are numbers and abbreviations.

Defined results: null text is empty and has no spans; repeated rows are scanned one by one but their seeds count
once; an empty table gives an empty table; further columns are ignored (redacted() carries them).
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, carried, chunks, mix, stored, table, utf8

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_SCORE, ROUNDS, BLOCK, SHORTEST = 5, 0.5, 3, 1 << 20, 6

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# only the first digit of a run can begin the leftmost match
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGIT_BYTE = re.compile(rb"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
#: The shape that a word must have to be a new instance of a kind.
SHAPES = {
    "email": re.compile(r"[^@\s]+@[^@\s]+"),
    "ip": re.compile(r"(?=.*[0-9])[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}"),
    "card": re.compile(r"[0-9](?:-?[0-9]){11,}"),
    "phone": re.compile(r"\(?[0-9](?:[().-]*[0-9]){6,14}"),
}
_EDGE = "\"'()[]{}<>.,;:!?"
_EDGES = _EDGE.encode()


def emails(text: str):
    """Leftmost, non-overlapping; each @ is looked at once, so a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    out.sort()
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_GLUE = np.zeros(256, bool)
_GLUE[list(b"=:")] = True


class Contexts:
    """Hashes of the four contexts of every word of a batch; 0 where a text has no such neighbour. The fourth is of the
    word's own front, and `lead` the bytes that it takes."""

    def __init__(self, col):
        self.buf, self.at = utf8(col)
        w = self.words = Words(self.buf, self.at, LOWER)
        h, n = w.hash, len(w.hash)
        place = np.arange(n) - w.first[w.doc]
        before1, before2, after = (np.zeros(n, np.uint64) for _ in range(3))
        before1[1:], before2[2:], after[:-1] = h[:-1], h[:-2], h[1:]
        one, two = place >= 1, place >= 2
        right = one & (place < w.count[w.doc] - 1)
        glue = np.flatnonzero(_GLUE[self.buf])
        self.lead = np.zeros(n, np.int64)
        if len(glue):
            word = np.searchsorted(w.start, glue, "right") - 1
            inside = glue + 1 < w.end[word]
            self.lead[word[inside]] = glue[inside] + 1 - w.start[word[inside]]
        front = np.where(self.lead > 0, mix(w.spans(w.start, w.start + self.lead) + np.uint64(4)), 0)
        self.keys = [np.where(one, mix(before1 + np.uint64(1)), 0), np.where(two, mix(before1 * np.uint64(3) ^ mix(before2) + np.uint64(2)), 0), np.where(right, mix(before1 * np.uint64(5) ^ mix(after) + np.uint64(3)), 0), front]
        self._chars = None

    def word(self, i: int, j: int) -> tuple[bytes, int]:
        """Of word i what context j leaves to an instance, and the byte where that begins."""
        start = int(self.words.start[i]) + (int(self.lead[i]) if j == 3 else 0)
        return self.buf[start : self.words.end[i]].tobytes(), start

    def chars(self, byte: int, d: int) -> int:
        """The code points of text d before a byte."""
        if self._chars is None:
            self._chars = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80, dtype=np.int64)])
        return int(self._chars[byte] - self._chars[self.at[d]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seeds(batches):
    """(pattern, kind, instance) of each seed that begins a word, or the part of it behind a glued front."""
    for b in chunks(batches, "text"):
        texts = b.column(0).to_pylist()
        c, rows = None, ([], [], [])
        for d, text in enumerate(texts):
            spans = base_spans(text or "")
            if not spans:
                continue
            c = c or Contexts(b.column(0))
            own = c.buf[c.at[d] : c.at[d + 1]]
            heads = None if len(own) == len(text) else np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
            for s, k, e in spans:
                byte, stop = (int(c.at[d]) + (x if heads is None else int(heads[x])) for x in (s, e))
                i = int(np.searchsorted(c.words.start, byte, "right")) - 1
                if i < 0:
                    continue
                last = int(np.searchsorted(c.words.start, stop - 1, "right")) - 1
                edge = lambda x: all(ch in _EDGES for ch in c.buf[x:byte].tobytes())  # noqa: E731, B023
                begins = edge(c.words.start[i])
                fronted = c.lead[i] > 0 and c.words.start[i] + c.lead[i] <= byte and edge(c.words.start[i] + c.lead[i])
                instance = int.from_bytes(hashlib.blake2b(text[s:e].encode(), digest_size=8).digest(), "little", signed=True)
                for j, keys in enumerate(c.keys):
                    if keys[i] and (fronted if j == 3 else begins and (j < 2 or last == i)):
                        for col, v in zip(rows, (int(keys[i].view(np.int64)), k, instance), strict=True):
                            col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], names=["pattern", "kind", "instance"])


def _candidate(word: bytes, kind: int) -> tuple[str, int, int] | None:
    """The core of a word and its place in it, if it has the kind's shape."""
    # every shape of an e-mail holds an @, every other one a digit
    if len(word) < SHORTEST or not (b"@" in word if KINDS[kind] == "email" else _DIGIT_BYTE.search(word)):
        return None
    text = word.decode()
    core = text.strip(_EDGE)
    if len(core) < SHORTEST or not SHAPES[KINDS[kind]].fullmatch(core):
        return None
    lead = text.index(core)
    return core, lead, lead + len(core)


def _counter(patterns: np.ndarray, kinds: np.ndarray):
    """How often each pattern occurs, and the instances of its kind's shape in its place."""

    def run(batches):
        total, found = np.zeros(len(patterns), np.int64), {}
        for b in chunks(batches, "text"):
            c = Contexts(b.column(0))
            for j, keys in enumerate(c.keys):
                at = np.searchsorted(patterns, keys)
                hit = np.flatnonzero(patterns[np.minimum(at, len(patterns) - 1)] == keys)
                at = at[hit]
                np.add.at(total, at, 1)
                for i, p in zip(hit, at, strict=True):
                    if got := _candidate(c.word(i, j)[0], int(kinds[p])):
                        instance = int.from_bytes(hashlib.blake2b(got[0].encode(), digest_size=8).digest(), "little", signed=True)
                        found[int(p), instance] = found.get((int(p), instance), 0) + 1
            if len(found) > 200_000:
                yield _counts(patterns, found)
                found = {}
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([_signed(patterns[seen]), pa.nulls(len(seen), pa.int64()), pa.array(total[seen])], names=["pattern", "instance", "n"])
        if found:
            yield _counts(patterns, found)

    return run


def _counts(patterns, found):
    return pa.RecordBatch.from_arrays([_signed(patterns[[p for p, _ in found]]), pa.array([i for _, i in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["pattern", "instance", "n"])


def induced(docs: DataFrame) -> DataFrame:
    """Scored patterns: pattern, kind, total, score. Stored."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    seeds = stored(texts.mapInArrow(_seeds, "pattern long, kind int, instance long").groupBy("pattern", "kind", "instance").agg(F.count("*").alias("n")), "pii-seeds")
    by_kind = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    best = by_kind.groupBy("pattern").agg(F.max_by("kind", F.struct("seeds", -F.col("kind"))).alias("kind"), F.max("seeds").alias("seeds"))
    best = stored(best.filter(F.col("seeds") >= MIN_SEEDS), "pii-patterns")
    n, counts = best.count(), None
    for k in range(max(1, -(-n // BLOCK))):
        parts = -(-n // BLOCK)
        block = best.filter(F.pmod(F.xxhash64("pattern"), F.lit(max(parts, 1))) == k).select("pattern", "kind").toArrow()
        if not block.num_rows:
            continue
        pattern = block.column("pattern").to_numpy().view(np.uint64)
        order = np.argsort(pattern)
        one = texts.mapInArrow(_counter(pattern[order], block.column("kind").to_numpy()[order]), "pattern long, instance long, n long")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return best.select("pattern", "kind", F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("score"))
    counts = stored(counts.groupBy("pattern", "instance").agg(F.sum("n").alias("n")), "pii-counts")
    total = counts.filter("instance IS NULL").select("pattern", F.col("n").alias("total"))
    trusted = seeds.select("pattern", "kind", "instance", "n", F.lit(True).alias("seed"))
    fresh = counts.filter("instance IS NOT NULL").join(best.select("pattern", "kind"), "pattern").join(seeds.select("kind", "instance").distinct(), ["kind", "instance"], "left_anti")
    edges = stored(trusted.join(best.select("pattern", "kind"), ["pattern", "kind"], "left_semi").unionByName(fresh.select("pattern", "kind", "instance", "n", F.lit(False).alias("seed"))).join(total, "pattern"), "pii-edges")
    worth = None
    for _ in range(ROUNDS):
        trust = F.when(F.col("seed"), 1.0).otherwise(F.coalesce(F.col("worth"), F.lit(0.0))) if worth is not None else F.when(F.col("seed"), 1.0).otherwise(0.0)
        known = edges if worth is None else edges.join(worth, ["kind", "instance"], "left")
        scored = stored(known.groupBy("pattern", "kind").agg(F.max("total").alias("total"), (F.sum(F.col("n") * trust) / F.max("total")).alias("score")), "pii-scores")
        worth = edges.filter("NOT seed").join(scored.select("pattern", "kind", "score"), ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max("score").alias("worth"))
    return scored


def _found(texts: list, c: Contexts | None, patterns: np.ndarray, kinds: np.ndarray, base: list) -> list:
    """base with the spans that patterns add; those never overlap a base span or each other."""
    if not len(patterns):
        return base
    out = [list(b) for b in base]  # sorted, and apart from base spans among themselves never overlapping
    reach = [list(np.maximum.accumulate([e for _, _, e in b])) if b else [] for b in base]
    for j, keys in enumerate(c.keys):
        at = np.searchsorted(patterns, keys)
        hit = np.flatnonzero(patterns[np.minimum(at, len(patterns) - 1)] == keys)
        for i, p in zip(hit, at[hit], strict=True):
            word, begin = c.word(i, j)
            got = _candidate(word, int(kinds[p]))
            if got:
                d = int(c.words.doc[i])
                start = c.chars(begin, d) + got[1]
                end = start + got[2] - got[1]
                k = bisect.bisect_left(out[d], (end,))  # spans that begin before the end; the farthest end of them tells
                if not k or reach[d][k - 1] <= start:
                    out[d].insert(k, (start, int(kinds[p]), end))
                    reach[d].insert(k, end)
    return out


def _spans(batch_col, patterns, kinds):
    texts = batch_col.to_pylist()
    base = [base_spans(t or "") for t in texts]
    return texts, base, _found(texts, Contexts(batch_col) if len(patterns) else None, patterns, kinds, base)


def trusted_patterns(docs: DataFrame, min_score: float = MIN_SCORE) -> list[tuple[np.ndarray, np.ndarray]]:
    """High-confidence patterns as sorted blocks of at most BLOCK."""
    good = induced(docs).filter(F.col("score") >= min_score).select("pattern", "kind")
    parts, out = -(-good.count() // BLOCK), []
    for k in range(parts):
        block = good.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).toArrow()
        pattern = block.column("pattern").to_numpy().view(np.uint64)
        order = np.argsort(pattern)
        out.append((pattern[order], block.column("kind").to_numpy()[order]))
    return out


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def detected(docs: DataFrame, patterns: list | None = None) -> DataFrame:
    """The spans of every document."""
    blocks = trusted_patterns(docs) if patterns is None else patterns
    merged = _merged(blocks)

    def run(batches):
        for b in chunks(batches, "text"):
            _, base, spans = _spans(b.column(1), *merged)
            n = [[sum(k == kind for _, k, _ in s) for s in base] for kind in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), pa.array([joined(s) for s in spans], pa.string()), pa.array([len(s) - len(x) for s, x in zip(spans, base, strict=True)], pa.int64()), pa.array(list(map(len, spans)), pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)


def _merged(blocks):
    """Blocks as one sorted table: 12 bytes a pattern, and patterns that score high on MIN_SEEDS different seeds
    are at most a MIN_SEEDS-th of the different seeds."""
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    pattern, kind = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(pattern)
    return pattern[order], kind[order]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, if there, follows."""
    merged = _merged(trusted_patterns(docs))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in chunks(batches, f"c{at}"):
            texts, _, spans = _spans(b.column(at), *merged)
            out = []
            for text, found in zip(texts, spans, strict=True):
                done, parts = 0, []
                for s, k, e in found:
                    if e <= done:
                        continue
                    parts += [text[done : max(s, done)], f"[{KINDS[k].upper()}]"]
                    done = e
                out.append(text if not found else "".join(parts) + text[done:])
            cols = list(b.columns)
            cols[at] = pa.array(out, b.schema.field(at).type)
            if "n_chars" in names and pa.types.is_integer(b.schema.field(names.index("n_chars")).type):
                cols[names.index("n_chars")] = pa.array([old if not found else len(t) for t, found, old in zip(out, spans, b.column(names.index("n_chars")).to_pylist(), strict=True)], b.schema.field(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return carried(docs, run)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
