"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. A text, folded to lower case
without digits and ASCII punctuation, is cut into pieces, each piece is compressed with every dictionary, and the language whose dictionary leaves the fewest bytes in all is chosen.
Where the margin to the second is narrow the choice is marked as rejected; `lang_pred` still names it, and
`lang_accepted` is `und` there.

Dictionaries are built on the driver from at most SAMPLE pieces of training texts a language (of LONGEST characters,
chosen by hash of the id and place; the documented bound), up to DICT_BYTES each; a language with less text has a
shorter dictionary, which changes no other. Prediction is one pass without a shuffle.

Defined results: null text and text without a letter (Unicode category L) are `und` with score 0; a language whose
training texts are all empty cannot be learned; on equal sizes the first language by name is taken; a null language is not learned;
without any language every text is `und`; repeated rows are alike; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold, table

SAMPLE, DICT_BYTES, LONGEST, PIECE, LEVEL = 80, 96 << 10, 16 << 10, 8 << 10, 5
#: A margin below this share of the smallest size, or these bytes, is narrow.
NARROW_SHARE, NARROW_BYTES = 0.004, 3
_LETTER = regex.compile(r"\p{L}")
_NOT_WORDS = bytes(c for c in range(33, 128) if not chr(c).isalpha())


def folded(text: str) -> bytes:
    """What is compressed: lower case, ASCII digits and punctuation dropped, as those mark no language."""
    return text.lower().encode().translate(None, _NOT_WORDS)


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Language: dictionary, from rows outside the held-out fold."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.coalesce(crc_fold("doc_id", 5) != 0, F.lit(False)))
    pieces = F.greatest(F.ceil(F.char_length("text") / LONGEST), F.lit(1)).cast("int")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(4.0 * SAMPLE / n))])
    rank = lambda k: F.when(k == 0, F.xxhash64("doc_id", F.lit(11))).otherwise(F.xxhash64("doc_id", F.lit(11), k))
    taken = F.filter(F.sequence(F.lit(0), pieces - 1), lambda k: F.pmod(rank(k), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    some = rows.withColumn("piece", F.explode(taken)).withColumn("rank", rank(F.col("piece")))
    some = some.select("lang", "rank", F.substring(F.col("text"), F.col("piece") * LONGEST + 1, F.lit(LONGEST)).alias("text"))
    out: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(some.collect(), key=lambda r: (r["rank"], r["text"])):
        if len(out[r["lang"]]) < SAMPLE:
            out[r["lang"]].append(folded(r["text"]))
    return {lang: filled(b"\n".join(parts)) for lang, parts in out.items() if any(p.strip() for p in parts)}


def filled(raw: bytes) -> bytes:
    """A dictionary of at most DICT_BYTES; zstandard needs some bytes, so a very short text is repeated."""
    return (raw if len(raw) >= 64 else (raw + b"\n") * (64 // (len(raw) + 1) + 1))[:DICT_BYTES]


@lru_cache(2)
def _packers(dicts: tuple):
    made = []
    for _, raw in dicts:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def judged(text: str | None, names: list[str], packers: list) -> tuple[str, float, bool]:
    """Language, score and whether the margin is wide enough."""
    if not text or not names or not _LETTER.search(text):
        return "und", 0.0, False
    raw = folded(text)
    sizes = np.zeros(len(names))
    for lo in range(0, len(raw), PIECE):
        piece = raw[lo : lo + PIECE]
        sizes += [len(p.compress(piece)) for p in packers]
    best = int(sizes.argmin())
    gaps = sizes - sizes[best]
    score = 1.0 / sum(math.exp(-min(g / (2.0 + 0.004 * sizes[best]), 700.0)) for g in gaps)
    margin = np.partition(gaps, 1)[1] if len(gaps) > 1 else math.inf
    return names[best], score, bool(margin >= max(NARROW_BYTES, NARROW_SHARE * sizes[best]))


def predicted(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, lang_accepted of every row; only the text is read."""
    fixed = tuple(sorted(dicts.items()))
    names = [n for n, _ in fixed]

    def run(batches):
        packers = _packers(fixed)
        for b in chunks(batches, "text"):
            got = [judged(t, names, packers) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] if g[2] else "und" for g in got], pa.string())], names=["doc_id", "lang_pred", "score", "lang_accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, lang_accepted string")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predicted(docs, dictionaries(docs))
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "lang_accepted")
