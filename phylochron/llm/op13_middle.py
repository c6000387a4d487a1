"""Fill-in-middle transformation of documents, cut at token boundaries by succinct rank and select.

The texts of a batch are one UTF-8 buffer, and a bit a byte says whether a unit (a word with the blanks before it, or blanks
at the end of the text) ends there. The bits are packed into 64-bit words; a directory holds the number of bits before
every block of eight words. rank(i) is a directory entry and popcounts of at most eight words; select(k) is a binary search
in the directory, then popcounts within one block and one word. A document's units are a difference of two ranks, its two
cuts are two selects. So the structure takes a bit a byte and a directory of an eighth of that, whatever the tokens are.

The hashes that decide form and cuts come from the document's id and a seed, so a document's result depends on nothing
else, and a lost task gives the same again. Rows keep their place: nothing is shuffled. A batch has at most CHUNK_BYTES of
text; a longer document is a batch of its own.

Defined results: null text is empty; an empty text, and one that holds a sentinel, stay as they are (form plain); a null
id is hashed as the empty string; repeated rows are each transformed alike; an empty table gives an empty table; further
columns of any name are carried by `transformed`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import SPACE, chunks, table, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
WORDS_A_BLOCK = 8


class Bits:
    """A packed bitvector with a directory of popcounts by block."""

    def __init__(self, bits: np.ndarray):
        block = 64 * WORDS_A_BLOCK
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(bits) // block + 1) * WORDS_A_BLOCK, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, WORDS_A_BLOCK)
        self.before = np.concatenate([[0], np.cumsum(ones.sum(axis=1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // WORDS_A_BLOCK
        out = self.before[block] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        for k in range(WORDS_A_BLOCK - 1):
            at_k = block * WORDS_A_BLOCK + k
            out = out + np.where(at_k < word, np.bitwise_count(self.words[at_k]), 0)
        return out.astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the set bit that has k set bits before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        left, word = k - self.before[block], block * WORDS_A_BLOCK
        for _ in range(WORDS_A_BLOCK - 1):
            here = np.bitwise_count(self.words[word]).astype(np.int64)
            onward = left >= here
            left, word = np.where(onward, left - here, left), np.where(onward, word + 1, word)
        within = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(within, axis=1) > left[:, None]).argmax(axis=1)


def unit_ends(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a unit ends with each byte: the last byte of a word, or of a text."""
    word = ~SPACE[buf]
    ends = word.copy()
    if len(buf):
        ends[:-1] &= ~word[1:]
        ends[at[1:][at[1:] > at[:-1]] - 1] = True
    return ends


def cuts(buf: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, first, second): units of each text, and the bytes of the buffer at which its prefix and its middle end."""
    bits = Bits(unit_ends(buf, at))
    ranks = bits.rank(at)
    n = np.diff(ranks)
    a, b = one % (n + 1), two % (n + 1)
    found = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place, some = at[:-1].copy(), k > 0
        place[some] = bits.select(ranks[:-1][some] + k[some] - 1) + 1
        found.append(place)
    return n, *found


def code_points(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of byte ranges."""
    total = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return total[end] - total[start]


def hashes(seed: int = SEED) -> list[Column]:
    """h1 to h4: the first groups of eight hex digits of the digest of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output."""
    kept, h = docs.columns, len(docs.columns)
    added = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    for i, (_, kind) in enumerate(added):
        schema = schema.add(f"x{i}", kind)

    def run(batches):
        for b in chunks(batches, "t"):
            buf, at = utf8(b.column(h + 4))
            h1, h2, h3, h4 = (b.column(h + k).to_numpy() for k in range(4))
            n, first, second = cuts(buf, at, h1, h2)
            raw = buf.tobytes()
            form, output = [], []
            for i, (s, x, y, e) in enumerate(zip(at[:-1].tolist(), first.tolist(), second.tolist(), at[1:].tolist(), strict=True)):
                text = raw[s:e]
                if not text or h3[i] % 100 >= fim_percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain")
                    output.append(text)
                    continue
                p, m, q = raw[s:x], raw[x:y], raw[y:e]
                form.append("spm" if h4[i] % 100 < spm_percent else "psm")
                parts = (SUFFIX, q, PREFIX, p, MIDDLE, m) if form[-1] == "spm" else (PREFIX, p, SUFFIX, q, MIDDLE, m)
                output.append(b"".join(v if isinstance(v, bytes) else v.encode() for v in parts))
            plain = np.array([f == "plain" for f in form], bool)
            lengths = [pa.array(code_points(buf, a, z), pa.int64(), mask=plain) for a, z in ((at[:-1], first), (first, second))]
            columns = [b.column(i) for i in range(h)] + [pa.array(n, pa.int64()), pa.array(form, pa.string()), *lengths, pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    given = docs.select(*[F.col(f"`{c}`") for c in kept], *hashes(seed), F.col("text").cast("string"))
    given = given.toDF(*[f"c{i}" for i in range(h)], "h1", "h2", "h3", "h4", "t")
    return given.mapInArrow(run, schema).toDF(*kept, *[name for name, _ in added])


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    def part(opening: str, closing: str | None) -> Column:
        begin = F.locate(opening, output) + len(opening)
        return F.substring(output, begin, F.length(output) if closing is None else F.locate(closing, output) - begin)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR ('0x' || h[17:24])::BIGINT % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
