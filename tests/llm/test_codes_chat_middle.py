"""Product codes, chat formatting and fill-in-middle against brute force on small tables with every odd case."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from phylochron.llm import op11_codes, op12_chat, op13_middle
from phylochron.llm import queries as registered

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_codes", "op12_chat", "op13_middle"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registered.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert rows == sorted(want.fetchall()) and rows


# codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, vector, label) of one usable length; returns {vec_id: (code, error, label_error)} and the digest."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[k * width : (k + 1) * width] for k in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        near = [[best(p, x)[1] for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), n in zip(kept, near, strict=True) if n[p] == k]
                if mine:
                    near_sum = [sum(c) for c in zip(*mine, strict=True)]
                    books[p][k] = [s // len(mine) for s in near_sum]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [best(p, x) for p, x in enumerate(cut(v))]
        error = sum(f for f, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, by_label[label]) for i, c, e, label in out), key=str), sha(text)


def vectors(n, seed=5, dims=16):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, rng.gauss(0, 1)]) for _ in range(dims)], rng.choice([1, 1, 2, None])) for i in range(n)]
    rows[3] = (3, rows[2][1], 1)  # equal seeds: the lower index takes all
    rows += [(n + k, rows[5][1], 2) for k in range(60)]  # a group of copies
    rows += [(n + 60, None, 1), (n + 61, [float("nan")] + [0.0] * (dims - 1), 1), (n + 62, [None] + [0.0] * (dims - 1), 1), (n + 63, [float("-inf")] * dims, 1), (n + 64, [], 1), (n + 65, [1.0] * 5, None), (n + 66, [1.0] * (2 * dims), 1)]
    return rows


def run_codes(spark, rows, schema="vec_id long, embedding array<double>, label int, error string", tail=("x",)):
    table = spark.createDataFrame([(*r, *tail) for r in rows], schema).repartition(3)
    kept = op11_codes.quantised(table).cache()
    books = op11_codes.trained(kept)
    codes = op11_codes.encoded(kept, books).cache()
    return codes, books


def test_codes(spark):
    rows = vectors(150)
    codes, books = run_codes(spark, rows)
    usable = [r for r in rows if r[1] is not None and len(r[1]) == 16]
    want, digest = plain_codes(usable)
    both = op11_codes.with_label_error(codes)
    got = sorted((tuple(r) for r in both.select("vec_id", "code", "error", "label_error").collect()), key=str)
    assert got == want and op11_codes.digest(books) == digest
    salted = op11_codes.salted(codes, codes.groupBy("label").agg({"error": "sum"}).toDF("label", "label_error"))
    assert sorted((tuple(r) for r in salted.select("vec_id", "code", "error", "label_error").collect()), key=str) == want


def test_codes_of_few_none_and_repeated_vectors(spark):
    few = [(1, [0.5] * 16, None), (2, [0.75] * 16, None), (None, [2.0] * 16, 1)]
    codes, books = run_codes(spark, few + few[:1])
    assert len(books[0]) == 4 and codes.count() == 4
    assert {r.vec_id: r.error for r in codes.collect()} == {1: 0, 2: 0, None: 0}
    codes, books = run_codes(spark, [(1, None, 1)])
    assert books == [] and op11_codes.with_label_error(codes).count() == 0
    huge, _ = run_codes(spark, [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1)])
    assert [r.error for r in huge.collect()] == [0, 0]


def test_kd_tree_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(1)
    for entries, spread in ((1, 50), (2, 3), (16, 2), (16, 1000), (200, 1000)):
        book, x = rng.integers(-spread, spread + 1, (entries, 4)), rng.integers(-spread, spread + 1, (500, 4))
        index, far, asked = op11_codes.KdTree(book).nearest(x)
        all_far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
        assert asked <= entries * len(x) and (entries < 200 or asked < entries * len(x) / 3)


# chat


def plain_chat(rows):
    """rows (conv_id, turn, role, text): what the contract says of each conversation, and whether its turns are in order."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -(10**9), r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        state, bad = "start", None
        allowed = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
        for k, (_, r, _) in enumerate(turns):
            if bad is None and (state, r) not in allowed:
                bad = k
            state = r
        out[conv] = (len(turns), sha(said), len(loss), sha(loss), bad is None and state == "assistant", bad)
    return out


HARD = ["", "\\", "\\\\<s>", "<s></s>", "[INST]", " [/INST] ", "<<SYS>>\n<</SYS>>\n\n", "[[INST]<", "<<", "<", "[", "a\\[INST]", "<\\s>", "<<ROLE>>x<</ROLE>>y<<END>>", "<<<END>>", "é🙂</s>é", "$1 \\$2", None, " \n", "<</s>"]


def test_chat(spark):
    rng = random.Random(9)
    roles = ["system", "user", "assistant", "tool", "", None, "<<END>>", "a\\</s>"]
    rows = [(conv, t, rng.choice(roles), "".join(x or "" for x in rng.choices(HARD, k=3)) if rng.random() < 0.9 else None) for conv in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100, 0, "user", "hi"), (100, 1, "assistant", "yes"), (100, 1, "assistant", "yes"), (101, None, "user", "x"), (101, 0, "assistant", None), (None, 0, "user", "n"), (102, 0, "user", "w " * 300_000), (102, 1, "assistant", "<s>" * 100_000)]
    rows += [(200 + k, t, "user" if t % 2 == 0 else "assistant", HARD[k]) for k in range(len(HARD)) for t in range(4)]
    table = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    made = op12_chat.formatted(table)
    got = made.select("conv_id", op12_chat.joined(made.segments).alias("text"), op12_chat.trained_text(made.segments).alias("loss"), "valid", "bad_turn")
    got = got.withColumn("turns", op12_chat.parsed(got.text)).collect()
    want = plain_chat(rows)
    assert len(got) == len(want)
    for r in got:
        said = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
        assert (len(r.turns), sha(said), len(r.loss), sha(r.loss), r.valid, r.bad_turn) == want[r.conv_id]
    assert op12_chat.formatted(table, strict=True).count() == sum(w[4] for w in want.values())
    assert op12_chat.formatted(table.limit(0)).count() == 0
    one = {r.conv_id: r for r in got}[100]
    assert one.text == "[INST] hi [/INST] yes</s> yes</s>" and not one.valid and one.bad_turn == 2


def test_chat_texts_hold_no_control_string(spark):
    t = op12_chat.Template()
    table = spark.createDataFrame([(x,) for x in HARD if x is not None], "text string")
    for (x,) in table.select(op12_chat.escaped(table.text, t)).collect():
        assert not any(c in x for c in t.controls)


def test_template_that_cannot_be_read_back(spark):
    for bad in (op12_chat.Template(reserved=("<s>x",), other=("<s>", "]]r", "]]e")), op12_chat.Template(roles={"a": ("<a>", " ")}), op12_chat.Template(roles={"a": ("<a>", "</a>"), "b": ("<a>b", "</b>")}), op12_chat.Template(reserved=("\\x",))):
        with pytest.raises(ValueError):
            bad.check()


# fill in the middle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    d = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(1000 + k, "".join(rng.choices(["a", "ü🙂", " ", "\n\t", "\x0b", "\x85", " ", "word", "<P", "P>", "<"], k=rng.randrange(0, 40)))) for k in range(300)]
    rows += [(1, "x<S>y"), (2, " "), (3, "\n\n"), (4, "x"), (5, ""), (6, None), (None, "a b c"), (7, "é " * 900_000), (7, "é " * 900_000), (8, "z" * 3_000_000)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, form int").repartition(3)
    for docs in (table.drop("form"), odd_docs.select("doc_id", "text")):
        made = op13_middle.transformed(docs)
        got = made.withColumn("back", op13_middle.restored(made.output, made.form)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text)
            assert r.back == (r.text or "")
    assert op13_middle.transformed(table).columns == ["doc_id", "text", "form", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert op13_middle.transformed(no_docs).count() == 0
    assert {r.form for r in op13_middle.transformed(table.drop("form"), fim_percent=100, spm_percent=0).select("form").collect()} == {"psm", "plain"}


def test_rank_and_select():
    rng = np.random.default_rng(4)
    for n, share in ((0, 0), (1, 1), (64, 1), (511, 0.5), (512, 0.01), (5000, 0.3), (20000, 0.001)):
        bits = rng.random(n) < share
        b = op13_middle.Bits(bits)
        total = np.concatenate([[0], np.cumsum(bits)])
        assert (b.rank(np.arange(n + 1)) == total).all()
        at = np.flatnonzero(bits)
        if len(at):
            assert (b.select(np.arange(len(at))) == at).all()
