"""The pipeline against a plain version of its stages."""

import collections
import importlib.util
import zlib

import numpy as np
import pytest

from .test_ops import KINDS, WORD, brute_components, brute_pii, brute_quality

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_stages(spark, odd_docs):
    import corpus_pipeline as p

    docs = odd_docs
    given = docs.columns
    stage = dict(p.STAGES)
    kept = stage["quality_rules"](spark, docs, "").cache()
    assert kept.columns == given and all(not brute_quality(r.text)[5] for r in kept.collect())
    one = stage["near_duplicates"](spark, kept, "").cache()
    sets, root = brute_components([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted({root(i) for i in sets if i is not None})
    clean = stage["personal_data"](spark, one, "").cache()
    assert clean.columns == given and sorted(map(str, clean.collect())) == sorted(str(tuple_of(r, redact(r.text))) for r in one.collect())
    mixed = stage["mixing"](spark, clean, "").cache()
    n = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == given and set(n) <= {r.doc_id for r in clean.collect()} and max(n.values()) <= 2
    words = lambda df: sum(len(WORD.findall(r.text or "")) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.15 * words(clean) + 3000
    packed = stage["packing"](spark, mixed, "").collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute_pieces(mixed.collect())
    room = collections.Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024


def redact(text):
    """The text with its spans, by the plain version, replaced by their kinds."""
    if not text:
        return text
    spans = [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in brute_pii([text])[0].split(",") if x)]
    out, done = "", 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], [n for n, _ in KINDS].index(x[1]))):
        if e > done:
            out += text[done : max(s, done)] + f"[{k.upper()}]"
            done = e
    return out + text[done:]


def tuple_of(row, text):
    fields = row.asDict() | {"text": text}
    if text != row.text:
        fields["n_chars"] = len(text)
    return type(row)(**fields)


def brute_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    given, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for r in rows:
        ids = [*given.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[start : head if k == 0 else start + 1024]
            out[r.doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, odd_docs):
    import corpus_pipeline as p

    clash = odd_docs.filter("doc_id IN (1, 2, 3, 9, 11)").selectExpr("*", "1 AS _c", "2 AS _n", "3 AS copies", "4 AS n_words", "5 AS component_id", "6 AS size", "7 AS spans")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and out.count() > 0
    for _, stage in p.STAGES:
        assert stage(spark, clash.limit(0), "").count() == 0


def test_run(spark):
    import corpus_pipeline as p

    assert p.run(spark, "/root/testdata/sf0.001").count() > 0
