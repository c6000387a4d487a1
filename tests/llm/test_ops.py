"""Operators against brute force on a small table with every odd case, and on an empty one."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from phylochron.llm import common, graph, op1_quality, op2_toxicity, op3_warc, op4_language, op5_mixing, op6_packing, op7_embeddings, op8_lm, op9_pii, op10_jaccard

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def test_words_are_the_contract_words():
    texts = ["a b\tc\x0bd", "", "  x ", "é ü\x85z A", None, "end"]
    w = common.Words(*common.utf8(pa.array(texts)))
    assert w.count.tolist() == [len(WORD.findall(t or "")) for t in texts]
    low = common.Words(*common.utf8(pa.array(["Ab ab É", "ab AB é"])), common.LOWER).hash
    assert low[0] == low[1] == low[3] == low[4] and low[2] != low[5]


def brute_quality(t):
    w = WORD.findall(t or "")
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(rep), failed


def test_quality(odd_docs, no_docs):
    got = op1_quality.quality(odd_docs)
    assert got.columns.count("kept") == 1
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text)
        assert not (r.base_failed and r.kept)
    texts = ["a\na\nb", "\n\n", "", "a b\n a b\na b", None, "q " * 30 + "\n" + "q " * 30]
    m = op1_quality.measure(pa.array(texts))
    assert [tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [brute_quality(t)[:5] for t in texts]
    passage = " ".join(f"w{i}" for i in range(60))
    m = op1_quality.measure(pa.array([passage + "\n" + " ".join(f"v{i}" for i in range(70)) + "\n" + passage]))
    assert m["dup_10gram_share"][0] > 0.4 and not m["kept"][0] and m["n_dup_lines"][0] == 1
    kept = op1_quality.filtered(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.filter("kept").collect()}
    assert op1_quality.quality(no_docs).count() == 0


@pytest.mark.parametrize("share", [0.22, 0.3, 0.38])
def test_quality_rejects_passages_that_cover_less_than_half(share):
    passage = " ".join(f"w{i:03}" for i in range(round(100 * share)))  # twice in 200 words
    rest = " ".join(f"v{i:03}" for i in range(200 - 2 * round(100 * share)))
    m = op1_quality.measure(pa.array([f"{passage} {rest} {passage}", " ".join(f"u{i:03}" for i in range(200))]))
    assert 0.2 < m["dup_10gram_share"][0] < 0.4 and not m["base_failed"].any() and m["kept"].tolist() == [False, True]


def test_toxicity_learns_and_scores_alike(spark, odd_docs, no_docs):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(300):
        t = list(rng.choice(words, 60))
        if i % 3 == 0:
            t[5] = rng.choice(["vileword", "badword!"])
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    model = op2_toxicity.fit(texts[:240], np.array(labels[:240]), ["en"] * 240)
    s = model.scores(pa.array([*texts[240:], "", None]))
    assert ((s[:60] >= 0.5) == np.array(labels[240:], bool)).mean() > 0.9 and ((s >= 0) & (s <= 1)).all()
    one = model.scores(pa.array(texts[240:260]))
    assert np.allclose(one, s[:20])
    out = op2_toxicity.scored(odd_docs, model)
    assert out.count() == odd_docs.count() and out.filter("score IS NULL OR predicted <> cast(score >= 0.5 AS int)").count() == 0
    assert op2_toxicity.learn(odd_docs, spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")) is None
    assert op2_toxicity.scored(odd_docs, None).filter("score <> 0").count() == 0
    assert op2_toxicity.scored(no_docs, model).count() == 0


def test_toxicity_of_many_languages():
    rng = np.random.default_rng(3)
    languages = [f"l{i:03}" for i in range(90)]
    texts, labels, langs = [], [], []
    for i in range(1800):
        lang = languages[i % 90] if i % 3 else "zz"  # the last one by name is the most frequent
        t = [f"{lang}{k}" for k in rng.integers(0, 30, 25)]
        bad = int(rng.integers(0, 2))
        if bad:
            t[7] = "vileword"
        texts.append(" ".join(t))
        labels.append(bad)
        langs.append(lang)
    model = op2_toxicity.fit(texts[:1500], np.array(labels[:1500]), langs[:1500])
    assert len(model.cut) == 2  # one for zz, one for all others
    s = model.scores(pa.array(texts[1500:]))
    assert ((s >= 0.5) == np.array(labels[1500:], bool)).mean() > 0.95
    again = model.scores(pa.array([*texts[1500:1510], *texts[1500:1510]]))
    assert np.array_equal(again[:10], again[10:])


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/%0A\n", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 90_000), (6, "u", "tail\r\n\r\n"), (6, "u", "tail\r\n\r\n"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    head = lambda *a: op3_warc.zlib.decompress(op3_warc.record(*a), 31).decode()
    first, again = head(9, "http://a\n", b"x", "D", None), head(4, "http://b", b"x", "D", 9, "http://a\n")
    assert "WARC-Date: 1970-01-01T00:00:00Z\r\n" in first and "WARC-Refers-To-Target-URI: http://a%0A\r\n" in again
    assert re.search("WARC-Record-ID: (.*)\r", first)[1] == re.search("WARC-Refers-To: (.*)\r", again)[1]
    index = op3_warc.write(pages, folder)
    got = op3_warc.read(index, folder).collect()
    assert len(got) == len(rows)
    want = {}
    for i, url, html in rows:
        raw = (html or "").encode()
        last = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        want.setdefault(i, (url, len(raw), __import__("base64").b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last, raw))
    for r in got:
        url, n, digest, kind, refers, raw = want[r.page_id]
        assert (r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (url, n, digest, kind, refers)
        assert bytes(r.payload) == (raw if kind == "response" else b"")
    some = op3_warc.read(index.filter("page_id = 5"), folder).collect()
    assert len(some) == 1 and len(some[0].payload) == 180_000
    empty = op3_warc.write(pages.limit(0), folder)
    assert op3_warc.read(empty, folder).count() == 0


def test_language(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "fr": ["eau", "ment", "que", "oi", "é"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(80))
    train = spark.createDataFrame([(i, make("en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(120)], "doc_id long, text string, lang string")
    dicts = op4_language.dictionaries(train)
    assert set(dicts) == {"en", "fr"}
    test = spark.createDataFrame([(i, make("en" if i % 2 else "fr").upper(), "x") for i in range(40)] + [(900, None, "x"), (901, "12 .. 7", "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in op4_language.predicted(test, dicts).collect()}
    assert sum(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40)) >= 38
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert op4_language.dictionaries(no_docs) == {} and op4_language.predicted(no_docs, dicts).count() == 0
    assert op4_language.predicted(odd_docs, {}).filter("lang_pred <> 'und'").count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mixing(odd_docs, no_docs):
    docs = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in odd_docs.collect()]
    sizes = collections.Counter()
    for _, s, n in docs:
        sizes[s] += n
    want = brute_targets(sizes)
    units, dual = op5_mixing.plan(odd_docs)
    got = {r.s: r.target for r in dual.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    rows = units.collect()
    assert sum(r.n for r in rows) == len(docs) and all(0 <= r.copies <= 2 for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.copies * r.size * r.n
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], max(n for _, x, n in docs if x == s))
    assert sorted(map(tuple, op5_mixing.plan(odd_docs.repartition(5))[0].collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert op5_mixing.mixed(odd_docs).columns == odd_docs.columns
    wanted = collections.Counter()
    for r in rows:
        wanted[r.doc_id, r.source, r.size] += r.n * r.copies
    clash = op5_mixing.mixed(odd_docs.selectExpr("*", "1 AS _c", "2 AS _d", "3 AS _n", "4 AS copies", "5 AS size", "6 AS `a.b`"))
    assert clash.columns[-6:] == ["_c", "_d", "_n", "copies", "size", "a.b"]
    assert collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in clash.collect()) == +wanted
    solved, size_of = {r.s: r for r in dual.collect()}, collections.defaultdict(list)
    for _, s, n in docs:
        size_of[s].append(n)
    for s, r in solved.items():  # the tilted rates meet the constraint
        if 0 < r.target < 2 * r.source_size:
            assert math.isclose(sum(2 * n / (1 + math.exp(-r.lam * n / r.mean)) for n in size_of[s]), r.target, rel_tol=1e-6)
    assert op5_mixing.mixed(no_docs).count() == 0
    assert op5_mixing.plan(no_docs)[0].count() == 0


def test_packing(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    given = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = collections.Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    want = collections.Counter()
    for (i, text), n in docs.items():
        ids = [*given.encode(text, add_special_tokens=False).ids, 2]
        assert op6_packing.ids_of(op6_packing.encoder(), text) == ids[:-1]
        for k, (start, length) in enumerate(op6_packing.cut(len(ids))):
            assert length == 1024 or k == 0
            want[i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += n
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y<|endoftext", "<|im_start|>"):
        assert op6_packing.ids_of(op6_packing.encoder(), text) == given.encode(text, add_special_tokens=False).ids
    rows = op6_packing.packed(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 1024) + 2
    assert op6_packing.packed(no_docs).count() == 0
    ids = [r.ids for r in op6_packing.pieces(odd_docs, keep_ids=True).filter("doc_id = 7").collect()]
    assert ids[0][-1] == 2


def test_bins_are_best_fit_and_bounded():
    rng = np.random.default_rng(4)
    bins, free = op6_packing.Bins(100, 5), {}
    for _ in range(2000):
        n = int(rng.integers(1, 101))
        fitting = [f for f in free.values() if f >= n]
        at, offset = bins.put(n)
        if fitting:
            assert 100 - offset == min(fitting)
        elif len(free) == 5:
            low = min(free.values())
            gone = [b for b in free if free[b] == low and b not in {x for s in bins.by_free for x in s}]
            assert len(gone) == 1
            del free[gone[0]]
        free[at] = 100 - offset - n
        if not free[at]:
            del free[at]
        assert len(free) <= 5 and sorted(free) == sorted(x for s in bins.by_free for x in s)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 16))
    x[100:160] = x[50] + 0.04 * rng.normal(size=(60, 16))
    for i in range(200, 300):
        x[i] = x[i + 300] + 0.05 * rng.normal(size=16)
    x[400] = x[401] = x[402]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [None, *[1.0] * 15], 0), (9004, [], 0), (9005, [1.0, 2.0], 0), (9006, [2.0, 4.0], None), (9007, x[402].tolist(), 0), (402, x[402].tolist(), 0)]
    got = op7_embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows[:2600]] + [9007, 402]
    u = np.concatenate([x, x[[402, 402]]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    by = {}
    for i, n in zip(ids, link.sum(1), strict=True):
        by[i] = n
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in zip(*np.nonzero(link), strict=True):
        p, q = root(ids[a]), root(ids[b])
        parent[max(p, q)] = min(p, q)
    for r in got:
        if r.vec_id in by:
            assert (r.n_links, r.component_id, r.kept) == (by[r.vec_id], root(r.vec_id), root(r.vec_id) == r.vec_id)
        elif r.vec_id in (9005, 9006):
            assert (r.n_links, r.component_id) == (1, 9005)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert op7_embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_dictionaries_of_long_texts_and_stray_names(spark):
    rng = np.random.default_rng(4)
    long = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(4000))
    rows = [(i, long("abcdefgh"), "aa") for i in range(10)] + [(100 + i, long("stuvwxyz")[:9000], "bb") for i in range(20)] + [(i, "hi", "zz") for i in range(200, 210)]
    dicts = op4_language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(dicts) == {"aa", "bb", "zz"} and len(dicts["aa"]) > 90_000 and len(dicts["bb"]) > 90_000 and 64 <= len(dicts["zz"]) < 100
    assert [op4_language.judged(t, ["aa"], op4_language._packers((("aa", dicts["aa"]),)))[0] for t in ("\u00bd \u00b2", "\u2167", "\u4e2d", "x")] == ["und", "und", "aa", "aa"]


class Blind:
    """A graph whose beams find a query's nearest vectors only if they are among the first `seen`."""

    def __init__(self, raw, seen):
        self.x, self.seen = (raw / np.linalg.norm(raw, axis=1)[:, None]).astype(np.float32), seen

    def ask(self, q, width):
        s = q @ self.x[: self.seen].T
        order = np.argsort(-s, 1)[:, :width]
        return order, np.take_along_axis(s, order, 1)


def test_audit_sees_rare_and_uneven_links():
    rng = np.random.default_rng(9)
    raw = rng.normal(size=(2000, 16))
    asked = rng.normal(size=(1500, 16))
    asked[[100, 700, 1333]] = raw[[1900, 1950, 1999]] + 0.01
    pairs = lambda: {p for a, b in op7_embeddings.found(Blind(raw, 1800), raw, asked, 0.95) for p in zip(a.tolist(), b.tolist())}
    assert pairs() == {(100, 1900), (700, 1950), (1333, 1999)}
    # a large group that beams find, beside pairs that they lose
    raw[:60] = raw[0] + 0.001 * rng.normal(size=(60, 16))
    asked[:500] = raw[0] + 0.001 * rng.normal(size=(500, 16))
    asked[1000:1200] = raw[1800:] + 0.001
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    assert pairs() == set(zip(*(x.tolist() for x in np.nonzero(unit(asked) @ unit(raw).T >= 0.95))))


def test_graph_finds_rare_pairs_with_few_cosines(monkeypatch):
    made, against, pairwise = [0], op7_embeddings.against, op7_embeddings.pairwise

    def counted(f, size):
        def run(a, b):
            made[0] += size(a, b)
            return f(a, b)

        return run

    monkeypatch.setattr(op7_embeddings, "against", counted(against, lambda a, b: len(a) * len(b)))
    monkeypatch.setattr(op7_embeddings, "pairwise", counted(pairwise, lambda a, b: len(a)))
    rng, n = np.random.default_rng(1), 8000
    x = rng.normal(size=(n, 64))
    x[-100:] = x[:100] + 0.2 * rng.normal(size=(100, 64))  # links of 200 vectors, none of any other
    ids = np.arange(n)
    g = op7_embeddings.Graph(op7_embeddings.unit(x).astype(np.float32), ids.view(np.uint64))
    width, recall = op7_embeddings.self_audited(g, x, ids, 0.95)
    audits = []
    got = {(i, j) for a, b in op7_embeddings.found(g, x, x, 0.95, ids, ids, width, audits) for i, j in zip(a.tolist(), b.tolist()) if i != j}
    assert made[0] < 0.4 * n * n and width < n // 8 and recall >= op7_embeddings.RECALL
    u = op7_embeddings.unit(x)
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.95), strict=True) if i != j}
    assert got <= true and len(got) >= 0.95 * len(true) and len(audits) == 1
    # the audits compare a fixed number of queries with the shard, whether links are rare or not
    made[0] = 0
    asked = op7_embeddings.Asked(g, x, x, 0.95, ids, ids)
    asked.counts(op7_embeddings.drawn(ids, op7_embeddings.AUDIT), n)
    assert made[0] <= op7_embeddings.AUDIT * (n + 200)


def test_beam_gives_each_node_once_and_the_best_first():
    rng = np.random.default_rng(6)
    x = op7_embeddings.unit(rng.normal(size=(300, 12))).astype(np.float32)
    q = op7_embeddings.unit(rng.normal(size=(140, 12))).astype(np.float32)  # more than one batch
    near = np.full((301, op7_embeddings.KEPT), 300)
    for i in range(300):  # a ring: nodes that are opened together share most of their neighbours
        near[i] = (i + np.arange(-12, 13)[np.arange(25) != 12]) % 300
    start = np.repeat([[5, 5, 150]], len(q), 0)  # an entry that is given twice
    true = q @ x.T
    for width in (2, 12, 300, 320):
        ids, sims = op7_embeddings.beam(x, near, q, start, width)
        for row, got, s in zip(range(len(q)), ids, sims, strict=True):
            some = got[got >= 0]
            assert len(set(some.tolist())) == len(some) and (np.diff(s[: len(some)]) <= 0).all()
            assert np.allclose(s[: len(some)], true[row, some], atol=1e-5) and (s[len(some) :] == -np.inf).all()
            assert width < 300 or len(some) == 300


def test_full_beams_give_all_links():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 32))
    x[:700] = x[0] + 0.02 * rng.normal(size=(700, 32))  # one group of near copies, wider than any first beam
    ids = np.arange(6000)
    g = op7_embeddings.Graph(op7_embeddings.unit(x).astype(np.float32), ids.view(np.uint64))
    got = op7_embeddings.Asked(g, x, x[:50], 0.95, ids[:50], ids).counts(np.arange(50), 12)
    u = op7_embeddings.unit(x)
    assert (got == (u[:50] @ u.T >= 0.95).sum(1) - 1).all() and got.min() > 600


def test_planted_copies_are_within_the_threshold():
    for dim in (1, 2, 64):
        raw = np.random.default_rng(3).normal(size=(50, dim))
        probes = op7_embeddings.planted(raw, np.arange(50), 0.95)
        assert len(probes) == 50 and (np.abs(op7_embeddings.pairwise(op7_embeddings.unit(probes), op7_embeddings.unit(raw[op7_embeddings.drawn(np.arange(50), 50)]))) >= 0.95 - 1e-9).all()


def test_diverse_against_plain_loops():
    rng = np.random.default_rng(7)
    x = op7_embeddings.unit(rng.normal(size=(60, 5))).astype(np.float32)
    cand = np.array([rng.permutation(30)[:20] for _ in range(30)])  # not the nodes themselves
    sim = np.einsum("mcd,md->mc", x[cand], x[30:])
    order = np.argsort(-sim, 1)
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    sim[:, 15:] = -np.inf
    sim[0] = -np.inf
    for row, got in enumerate(op7_embeddings.diverse(x, cand, sim, 8)):
        kept, left = [], []
        for c, s in zip(cand[row].tolist(), sim[row].tolist(), strict=True):
            if s > -np.inf:
                (kept if len(kept) < 8 and all(x[k] @ x[c] < s for k in kept) else left).append(c)
        want = (kept + left)[:8]
        assert got.tolist() == want + [-1] * (8 - len(want))


def test_embeddings_of_one_large_group_and_of_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(op7_embeddings, "PAIRS", 5000)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 1536)).astype(np.float32)
    x[:600] = x[0] + 0.05 * rng.normal(size=(600, 1536))  # a group above half of the shard
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in op7_embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string").withColumn("n", F_lit())).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    assert all(got[i].n_links == link[i].sum() - 1 and got[i].component_id == (0 if i < 600 else i) for i in range(900))


def F_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_forest_of_links_in_pieces():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, 900), rng.integers(0, 400, 900)
    trees, kept = op7_embeddings.Forest(400), []
    for lo in range(0, 900, 70):
        kept += list(zip(*(x.tolist() for x in trees.add(a[lo : lo + 70], b[lo : lo + 70]))))
    parent = list(range(400))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in kept:
        assert root(u) != root(v)  # no link of a forest closes a ring
        parent[root(u)] = root(v)
    assert all(root(int(u)) == root(int(v)) for u, v in zip(a, b))


def test_language_model(odd_docs, no_docs):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    c = collections.Counter()
    for i, t in rows:
        if fold(i, 7) != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, fold(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    got = op8_lm.scored(odd_docs, common.crc_fold("doc_id", 7) == 2).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert op8_lm.scored(no_docs, F.lit(False)).count() == 0


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 40, 700):
        m = op8_lm.MaxEnt(rng.integers(1, 90, n).astype(float), 10)
        m.weights += rng.normal(0, 0.5, 1024).astype(np.float32)
        keys = [np.full(n, k, np.uint64) for k in (7, 8, 9)]
        assert abs((10.0 ** m.log10(np.arange(n), keys)).sum() - 1) < 1e-4


def test_model_starts_from_counts_and_paths_are_short_for_frequent_symbols():
    mass = np.array([50.0, 1, 30, 1, 7, 11])
    m = op8_lm.MaxEnt(mass, 8)
    got = 10.0 ** m.log10(np.arange(6), [np.zeros(6, np.uint64)] * 3)
    assert np.allclose(got, mass / mass.sum(), atol=1e-6) and m.length[0] == 1 and m.length[1] == max(m.length)


def brute_model(texts, train, rounds=op8_lm.ROUNDS):
    """The model by plain loops over tokens and path steps: log10 probability of every text."""
    from phylochron.llm.op8_lm import END_HASH

    seqs = []
    for t in texts:
        w = common.Words(*common.utf8(pa.array([t])), common.LOWER)
        seqs.append([*map(int, w.hash), int(END_HASH)])
    counts = collections.Counter(h for q, own in zip(seqs, train) if own for h in q)
    n = sum(counts.values())
    least, bits = max(2, -(-n // op8_lm.HEAD)), op8_lm.class_bits(n)
    head = sorted(h for h, c in counts.items() if c >= least)
    of = lambda h: int(op8_lm.tail_class(np.array([h], np.uint64), bits)[0])
    mass = [1.0] * 2**bits
    for h, c in counts.items():
        if c < least:
            mass[of(h)] += c + 1
    model = op8_lm.MaxEnt(np.array([*(counts[h] for h in head), *mass]), op8_lm.LEAST_BITS)
    place = {h: i for i, h in enumerate(head)}
    short = lambda h: int(common.mix(np.array([h], np.uint64))[0]) >> 32
    mix1 = lambda x: int(common.mix(np.array([x % 2**64], np.uint64))[0])
    weights = collections.defaultdict(float)

    def steps(q, i):
        one, two = (short(q[i - k]) if i >= k else short(int(END_HASH)) for k in (1, 2))
        keys = [mix1(one + 0x1D8E4E27), mix1(two + 2**40), mix1(one * 0x9E3779B97F4A7C15 % 2**64 ^ two + 2**50)]
        s = place.get(q[i], len(head) + of(q[i]))
        for j in range(model.start[s], model.start[s] + model.length[s]):
            node = int(model.node[j])
            at = [((k ^ node * 0xD6E8FEB86659FD93 % 2**64) * 0xFF51AFD7ED558CCD % 2**64) >> (64 - model.bits) for k in keys]
            yield at, int(model.side[j]), 1 / (1 + math.exp(-(float(model.bias[node]) + sum(weights[a] for a in at))))

    for _ in range(rounds):
        slope, bend = collections.Counter(), collections.Counter()
        for q, own in zip(seqs, train):
            for i in range(len(q) if own else 0):
                for at, side, p in steps(q, i):
                    for a in at:
                        slope[a] += side - p
                        bend[a] += p * (1 - p)
        for a in bend:
            weights[a] += op8_lm.RATE * slope[a] / (bend[a] + op8_lm.RIDGE)
    out = []
    for q in seqs:
        total = 0.0
        for i, h in enumerate(q):
            total += sum(math.log10(p if side else 1 - p) for _, side, p in steps(q, i))
            total += 0.0 if h in place else math.log10((counts[h] + 1) / mass[of(h)])
        out.append(total)
    return out


def test_model_against_plain_loops_and_other_partitions(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(12)
    words = ["the", "of", "Cat", "dog", "runs", "sits", *[f"r{i}" for i in range(40)]]
    texts = [" ".join(rng.choice(words[: rng.choice([6, 46])]) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + ["the cat runs", "the cat runs", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 4 == 0
    want = brute_model([t or "" for t in texts], [i % 4 != 0 for i in range(len(texts))])
    for parts in (1, 3):
        got = {r.doc_id: r for r in op8_lm.scored(docs.repartition(parts), held).collect()}
        assert all(math.isclose(got[i].score, w, abs_tol=1e-3) for i, w in enumerate(want))
    # a text that occurs twice is likelier, a token, than its words by themselves
    assert got[41].score > got[41].base_score


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(t):
    def fine(k, s):
        digits = re.sub("[^0-9]", "", s)
        if k == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if k == 2:
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return k == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, (_, p) in enumerate(KINDS) for m in re.finditer(p, t) if fine(k, m[0]))


def test_base_spans():
    import random

    rng = random.Random(8)
    bits = ["a@b.co", "@", "a@b", ".", "x.y@z-q.w.v", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", "+", " ", "-", "é", "42", "%+_", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert op9_pii.base_spans(t) == brute_spans(t), t
    op9_pii.base_spans("7" * 200_000 + "a" * 200_000)


def test_pii(spark, odd_docs, no_docs):
    for r in op9_pii.detected(odd_docs).collect():
        assert r.n_added >= 0 and len(r.base_sha256) == 64
    rows = [(i, f"note {i} and\nmy login is u{i}@host{i}.example.org thanks a lot") for i in range(30)] + [(99, "so then my login is weird@localbox thanks a lot"), (98, "the word is here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op9_pii.detected(docs).collect()}
    assert got[99].n_email == 0 and got[99].spans == "email:20:34" and got[98].spans == ""
    assert got[3].n_email == 1 and got[3].n_added == 0
    assert hashlib.sha256(got[3].spans.encode()).hexdigest() == got[3].base_sha256
    red = op9_pii.redacted(odd_docs)
    assert red.columns == odd_docs.columns and "[EMAIL]" in red.filter("doc_id = 11").first().text
    assert red.filter("doc_id = 5").first().text is None
    assert op9_pii.detected(no_docs).count() == 0 == op9_pii.redacted(no_docs).count()


def brute_pii(texts):
    """Spans of every text by plain loops: words and strings for contexts, dictionaries for the graph."""
    edges = op9_pii._EDGE
    words = [[(m.start(), m.end(), lower(m[0])) for m in WORD.finditer(t)] for t in texts]

    def contexts(ws, text, i):
        start, end, _ = ws[i]
        glue = max((p for p in range(start, end - 1) if text[p] in "=:"), default=None)
        yield (0, ws[i - 1][2]) if i >= 1 else None, start
        yield (1, ws[i - 2][2], ws[i - 1][2]) if i >= 2 else None, start
        yield (2, ws[i - 1][2], ws[i + 1][2]) if 1 <= i < len(ws) - 1 else None, start
        yield (3, lower(text[start : glue + 1])) if glue is not None else None, start if glue is None else glue + 1

    def candidate(text, begin, end, kind):
        word = text[begin:end]
        core = word.strip(edges)
        if len(core) < 6 or not op9_pii.SHAPES[KINDS[kind][0]].fullmatch(core) or (kind and not re.search("[0-9]", core)):
            return None
        at = begin + word.index(core)
        return at, at + len(core)

    seeds = collections.defaultdict(collections.Counter)
    for t, ws in zip(texts, words, strict=True):
        for s, k, e in brute_spans(t):
            for i, (a, b, _) in enumerate(ws):
                if a <= s < b:
                    for j, (pattern, begin) in enumerate(contexts(ws, t, i)):
                        if pattern and begin <= s and all(ch in edges for ch in t[begin:s]) and (j != 2 or e <= b):
                            seeds[pattern, k][t[s:e]] += 1
    kind_of = {}
    for pattern in {p for p, _ in seeds}:
        n, k = max((len(seeds[pattern, k]), -k) for k in range(4))
        if n >= op9_pii.MIN_SEEDS:
            kind_of[pattern] = -k
    total, found = collections.Counter(), collections.defaultdict(collections.Counter)
    for t, ws in zip(texts, words, strict=True):
        for i in range(len(ws)):
            for pattern, begin in contexts(ws, t, i):
                if pattern in kind_of:
                    total[pattern] += 1
                    if got := candidate(t, begin, ws[i][1], kind_of[pattern]):
                        found[pattern][t[got[0] : got[1]]] += 1
    known = {(k, x) for (p, k), c in seeds.items() for x in c}
    worth = {}
    for _ in range(op9_pii.ROUNDS):
        score = {}
        for p, k in kind_of.items():
            fresh = sum(n * worth.get((k, x), 0.0) for x, n in found[p].items() if (k, x) not in known)
            score[p] = (sum(seeds[p, k].values()) + fresh) / total[p]
        worth = {}
        for p, k in kind_of.items():
            for x in found[p]:
                if (k, x) not in known:
                    worth[k, x] = max(worth.get((k, x), 0.0), score[p])
    out = []
    for t, ws in zip(texts, words, strict=True):
        spans = [tuple(x) for x in brute_spans(t)]
        for j in range(4):
            for i in range(len(ws)):
                pattern, begin = list(contexts(ws, t, i))[j]
                if pattern in kind_of and score[pattern] >= op9_pii.MIN_SCORE and (got := candidate(t, begin, ws[i][1], kind_of[pattern])):
                    if not any(s < got[1] and got[0] < e for s, _, e in spans):
                        spans.append((got[0], kind_of[pattern], got[1]))
        out.append(op9_pii.joined(sorted(spans)))
    return out


def test_pii_against_plain_loops(spark):
    import random

    rng = random.Random(21)
    texts = []
    for i in range(160):
        host = f"10.{i}.3.{rng.randrange(200)}" if i % 3 else f"fe80::{i}:ab"
        mail = f"é{rng.choice('xyz')} user{i}@h{i}.org" if i % 4 else f"user{i}@intern"
        phone = f"+1 555 {i:03}-{i:04}" if i % 2 else f"(555){i:03}-{i:04}"
        texts.append(f"w{rng.randrange(50)} host={host} up, mail me: {mail} or call me {phone} x{rng.randrange(9)} ünd {rng.choice(['', 'host=none', 'mail me: now', 'host:=1.2.3.4'])}")
    texts += ["", "host=10.0.0.1 " * 300, "é" * 500 + " host=1.2.3 " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op9_pii.detected(docs).collect()}
    assert [got[i].spans for i in range(len(texts))] == brute_pii(texts)
    assert sum(r.n_added for r in got.values()) > 40 and all(r.n_spans == (r.spans.count(",") + 1 if r.spans else 0) for r in got.values())


def test_pii_counts_instances_without_digits(spark):
    name = lambda i: "u" + "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, f"so then my login is {name(i)}@{'host.example.org' if i % 5 < 2 else 'localbox'} thanks a lot") for i in range(100, 150)]
    got = {r.doc_id: r for r in op9_pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((r.n_email, r.n_added) == ((1, 0) if i % 5 < 2 else (0, 1)) for i, r in got.items())
    assert got[102].spans == "email:20:33"


def brute_components(rows, percent=80):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i].append(s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return sets, root


def test_jaccard(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    sets, root = brute_components(rows)
    got = op10_jaccard.similar(odd_docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id)) and r.n_shingles in {len(s) for s in sets[r.doc_id]}
    kept = op10_jaccard.one_of_each(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and sorted(i for i in ids if i is not None) == sorted({root(i) for i in sets if i is not None}) and ids.count(None) == 1
    assert op10_jaccard.similar(no_docs).count() == 0


@pytest.mark.parametrize("flush", [7, 100, 10**6])
def test_jaccard_keys_of_one_set_only_are_dropped(monkeypatch, flush):
    monkeypatch.setattr(op10_jaccard, "_FLUSH", flush)
    rng = np.random.default_rng(3)
    rows = [*zip(rng.integers(0, 60, 300).tolist(), rng.integers(0, 9, 300).tolist()), *((1000 + i, i) for i in range(50)), *((7, i) for i in range(100)), (5000, 1), (5000, 1)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[lo : lo + 5])], names=["key", "d1"]) for lo in range(0, len(rows), 5)]
    got = {r for b in op10_jaccard._shared(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    sets = collections.defaultdict(set)
    for k, d in rows:
        sets[k].add(d)
    assert got == {(k, d) for k, s in sets.items() if len(s) > 1 for d in s}
    assert list(op10_jaccard._shared(iter([]))) == []


def test_jaccard_repeated_ids_join_all_their_texts(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(5, text("a")), (9, text("a")), (9, text("b")), (9, text("c")), (7, text("b")), (8, text("c")), (6, text("d"))]
    got = {(r.doc_id, r.component_id) for r in op10_jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (8, 5), (6, 6)}


def test_one_of_each_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "x", 1, 2, 3), (2, "a b c d e f g", "y", 1, 2, 3), (3, "", "z", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _c string, _n int, _id int, component_id int")
    got = op10_jaccard.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_jaccard_finds_pairs_at_the_threshold(spark):
    import random

    rng = random.Random(9)
    rows, k = [], 0
    for n in (5, 6, 9, 13, 14, 20, 31, 33, 50, 64, 79, 90, 127, 129, 260, 520, 900):
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
            rows.append((k, " ".join(base)))
            for change in (rng.randrange(1, 3), max(1, n // 45), max(1, n // 40)):
                other = list(base)
                for _ in range(change):
                    other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
                cut = rng.randrange(0, max(1, n // 9))
                k += 1
                rows.append((k, " ".join(other[cut:])))
            k += 1
    sets, root = brute_components(rows)
    got = {r.doc_id: r.component_id for r in op10_jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets}
    assert len({root(i) for i in sets}) < len(sets)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 164)] + [(5, 9), (9, 7), (1, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 165)} | {5: 5, 9: 5, 7: 5, 1: 1, 2: 1}


@pytest.mark.parametrize("name", ["op3_warc"])
def test_sql(spark, name):
    import duckdb

    from phylochron.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.queries()[name](spark, "/root/testdata/sf0.001").select(*columns).collect())


def test_jaccard_in_a_large_group_of_near_copies(spark):
    import random

    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(140):
        other = list(base)
        for _ in range(rng.randrange(1, 7)):
            other[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(other)))
    rows += [(1000 + k, " ".join(base[:40] + [f"y{rng.randrange(10**6)}" for _ in range(110)])) for k in range(60)]
    sets, root = brute_components(rows)
    got = {r.doc_id: r.component_id for r in op10_jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets}
    assert 1 < len({root(i) for i in range(140)}) + 1 < 140 and all(root(1000 + k) == 1000 + k for k in range(60))
