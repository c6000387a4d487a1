"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths measure how many of a text's word characters lie inside
n-grams that the same text repeats, and how many of its characters lie inside repeated lines.
One pass, no shuffle, memory bounded by one batch of texts (a longer text is its own batch).

Defined results: a null or empty text has no words and is rejected by the base rule (n_words < 50);
repeated rows are judged one by one; an empty table gives an empty table; further columns are carried,
and a column that has the name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, carried, chunks, grams, mix, per_doc, table, utf8

#: Length of n-gram: largest share of word characters that may lie inside repeated ones. Just above the largest shares
#: of rows labelled good that the base rule passes (sf0.1, 3243 rows: 0.276, 0.276, 0.177; of lines 0.136).
COVER = {5: 0.30, 7: 0.28, 10: 0.20}
#: Largest share of a text's characters inside lines that repeat an earlier line.
LINE_COVER = 0.20
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("dup_line_share", "double"), *[(f"dup_{n}gram_share", "double") for n in COVER], ("base_failed", "boolean"), ("kept", "boolean")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where a key has occurred before."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The figures of each text of a string column."""
    buf, at = utf8(col)
    w = Words(buf, at)
    lead = (buf & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    length = chars[w.end] - chars[w.start]
    docs = w.doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    out = {"n_words": w.count, "word_chars": per_doc(length, w.first), "n_symbols": per_doc(_SYMBOL[buf], at)}

    breaks = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    owner = np.searchsorted(at[1:-1], begin, "right") if len(at) > 2 else np.zeros(len(begin), np.int64)
    # a text's first line begins at its own start; of empty texts that share a start only the last can hold words
    end = np.minimum(np.append(begin[1:], len(buf)), at[1:][owner]) if len(begin) else begin
    end = np.where((end > begin) & np.isin(end - 1, breaks), end - 1, end)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, owner = begin[worded], end[worded], owner[worded]
    again = later(mix(w.spans(begin, end) + owner.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    out["n_dup_lines"] = np.bincount(owner[again], minlength=len(col)).astype(np.int64)
    line_chars = np.bincount(owner[again], weights=(chars[end] - chars[begin])[again], minlength=len(col))
    out["dup_line_share"] = line_chars / np.maximum(chars[at[1:]] - chars[at[:-1]], 1)

    covered_chars = np.maximum(out["word_chars"], 1)
    place = None  # a longer n-gram can repeat only where a shorter one does
    for n in (WINDOW, *COVER):
        covered = np.zeros(len(w.hash), bool)
        if len(w.hash) >= n:
            g = grams(w.hash, n)
            whole = w.doc[: len(g)] == w.doc[n - 1 :]
            place = np.flatnonzero(whole) if place is None else place[(place < len(g))]
            place = place[whole[place]]
            place = place[repeated(mix(g[place] + docs[place]))]
            for k in range(n):
                covered[place + k] = True
        if n == WINDOW:
            out["n_repeat_words"] = per_doc(covered, w.first)
        else:
            out[f"dup_{n}gram_share"] = per_doc(length * covered, w.first) / covered_chars
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    good = out["dup_line_share"] <= LINE_COVER
    for n, most in COVER.items():
        good &= out[f"dup_{n}gram_share"] <= most
    out["kept"] = good & ~out["base_failed"]
    return out


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the figures and the verdict of each row."""
    rest = [f for f in docs.schema if f.name not in dict(FIELDS)]
    names = [f.name for f in rest]
    at = names.index(text)

    def run(batches):
        for b in chunks(batches, f"c{at}"):
            m = measure(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(m[n], _ARROW[k]) for n, k in FIELDS]], names=[*b.schema.names, *[f"x{i}" for i in range(len(FIELDS))]])

    return carried(docs.select(*[f"`{n}`" for n in names]), run, FIELDS)


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; texts leave Python only if kept."""
    at = docs.columns.index(text)

    def run(batches):
        for b in chunks(batches, f"c{at}"):
            yield b.filter(pa.array(measure(b.column(at))["kept"]))

    return carried(docs, run)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[n for n, _ in FIELDS])
