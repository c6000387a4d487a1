"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become token ids (byte-level BPE, then an end id); longer ones are cut so that every piece but the
first is full. Pieces are packed by bounded-space online best-fit: a fixed number of open bins, the free space
of which is the place of a bit in an integer, so that the tightest bin that fits is one shift and one mask;
when all bins are open and another is needed, the fullest closes. A look-ahead block is handed over longest
first. Full pieces are sequences of their own and need no bin.

Tokens are made once and stay in their task unless asked for; only lengths are dealt out for packing, in groups
chosen by a hash of the piece, so a hot source or a group of copies is spread evenly.

Ids: those of the `tokenizers` file given by `path`. Its vocabulary's rank form is read with tiktoken, which
gives the same ids several times faster (tests compare the two). A special token of that file, spelled out in a
text, is its id there, as the file encodes it.

Defined results: null text is empty, so its piece is the end id alone; repeated rows are pieces of their own;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, table

SEQUENCE, END_ID, OPEN_BINS = 1024, 2, 512
#: The special token of the vocabulary: fixed values.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces that are looked ahead and handed over longest first; the open bins stay from one such block to the next.
BLOCK = 512
#: Pieces of a group, which is packed online by itself, and the most groups.
GROUP_PIECES, MAX_GROUPS = 16_384, 1 << 22

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@lru_cache(2)
def encoder(path: str | None = None):
    """The tokenizer; path: a rank file, by default the public byte-level BPE."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def ids_of(encoding, text: str) -> list[int]:
    if any(s in text for s in SPECIAL):
        return encoding.encode(text, allowed_special="all")
    return encoding.encode_ordinary(text)


def cut(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    head = n % sequence or sequence
    return [(0, head), *[(s, sequence) for s in range(head, n, sequence)]]


def pieces(docs: DataFrame, keep_ids: bool = False, sequence: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every document's pieces; ids only if asked for."""

    def run(batches):
        encoding = encoder(path)
        for b in chunks(batches, "text"):
            rows = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of(encoding, text or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), sequence)):
                    part = ids[start : start + length]
                    for col, v in zip(rows, (doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


class Bins:
    """At most `most` open bins of `size`; the tightest that fits is found by one mask."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.bits, self.open, self.by_free, self.count = 0, 0, [[] for _ in range(size + 1)], 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset of the next item."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.by_free[free]
            at = stack.pop()
            self.open -= 1
            if not stack:
                self.bits ^= 1 << free
        else:
            if self.open >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                self.open -= 1
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
            free, at = self.size, self.count
            self.count += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(at)
            self.open += 1
        return at, self.size - free


def pack_lengths(lengths: np.ndarray, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; blocks are handed over longest first."""
    bins, where, offset = Bins(sequence, open_bins), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for lo in range(0, len(lengths), block):
        part = lengths[lo : lo + block]
        for i in np.argsort(-part, kind="stable"):
            where[lo + i], offset[lo + i] = bins.put(int(part[i]))
    return where, offset


def pack(parts: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, total: int | None = None) -> DataFrame:
    """Pieces (stored) with sequence and offset."""
    n = parts.count() if total is None else total
    groups = max(1, min(MAX_GROUPS, n // GROUP_PIECES))

    def run(key, batch):
        group = key[0].as_py()
        where, offset = pack_lengths(batch.column("length").to_numpy(), sequence, open_bins)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.Table.from_arrays([*[batch.column(k) for k in names], pa.array(where + (group << 40)), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    keyed = parts.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), F.lit(groups)).cast("long"))
    return keyed.repartition("g").groupBy("g").applyInArrow(run, PACKED)


def packed(docs: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every document's pieces with the sequence and the place they are packed into."""
    return pack(stored(pieces(docs, False, sequence, end_id, path).drop("ids"), "pieces"), sequence, open_bins)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
