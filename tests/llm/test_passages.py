"""The Jaccard join on documents that share a passage without being similar: pairs to verify must not grow with the square."""

import random

import pytest
from pyspark.sql import functions as F

from phylochron.llm import op10_jaccard


def shared_passage(n, own, rng):
    """n documents of one passage of 60 words with `own` words of their own behind it, in fours of near copies."""
    passage = [f"p{k}" for k in range(60)]
    out = []
    for k in range(n):
        rest = [f"d{k // 4}w{i}" for i in range(own)]
        if k % 4:
            rest[rng.randrange(own)] = f"x{k}"
        out.append((k, " ".join([*passage, *rest])))
    return out


def brute(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: find(k) for k in range(len(rows))}


@pytest.mark.parametrize("own", [8, 12, 30])
def test_verified_pairs_grow_linearly(spark, monkeypatch, own):
    verified, counts = op10_jaccard.verified, []

    def counted(pairs, members, percent=80):
        counts[-1] += pairs.count()
        return verified(pairs, members, percent)

    monkeypatch.setattr(op10_jaccard, "verified", counted)
    for n in (200, 400):
        counts.append(0)
        rows = shared_passage(n, own, random.Random(n))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in op10_jaccard.similar(df).collect()}
        assert got == brute(rows)
    assert counts[0] < 8 * 200 and counts[1] < 8 * 400, counts


def test_pairs_by_rare_shingles_lose_none(spark):
    """Every similar pair of different components is found, for sizes near each other and apart, with frequent shingles."""
    rng = random.Random(3)
    words = [f"v{k}" for k in range(40)]
    rows = []
    for k in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        rows.append(base)
        other = list(base)
        for _ in range(rng.randrange(0, 3)):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows.append(other[: len(other) - rng.randrange(0, 3)])
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sets = df.mapInArrow(op10_jaccard._sets(80), op10_jaccard._SET).filter("n > 0")
    sets = sets.groupBy("n", "d1", "s0", "s1", "s2", "s3").agg(F.min("doc_id").alias("rep")).withColumn("component", F.col("rep")).cache()
    members = op10_jaccard.packed_texts(sets.select(F.col("rep").alias("id")), df)
    got = {(r.a, r.b) for r in op10_jaccard.rare_pairs(sets, members, lambda d, *_: d.cache(), 2).collect()}
    shingles = {r.rep: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for r in sets.collect() for w in [rows[r.rep][1].split()]}
    want = {(a, b) for a in shingles for b in shingles if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])}
    assert want <= got and len(want) > 20


def open_sets(spark, texts):
    """Sets of their own component each, and the texts that rare shingles are taken from."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    sets = df.mapInArrow(op10_jaccard._sets(80), op10_jaccard._SET).withColumn("rep", F.col("doc_id")).withColumn("component", F.col("doc_id")).select("rep", "d1", "n", "s0", "s1", "s2", "s3", "component").cache()
    return sets, op10_jaccard.packed_texts(sets.select(F.col("rep").alias("id")), df).cache()


def test_similar_sets_become_one_component_by_chains(spark):
    """60 near copies have 1 770 pairs; chains have a pair a row at most, and leave none to the join."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(w if i != at else f"x{k}" for i, w in enumerate(base)) for k in range(60) for at in [rng.randrange(300)]]
    sets, members = open_sets(spark, texts)
    rows = op10_jaccard.rare_rows(sets.drop("component"), members, lambda d, *_: d.cache(), 2)
    label = sets.select(F.col("rep").alias("node"), "component")
    pairs = {(r.a, r.b) for r in op10_jaccard.chained_pairs(op10_jaccard.open_rows(rows, label), 0).collect()}
    root = list(range(60))
    for a, b in sorted(pairs):
        root = [root[a] if x == root[b] else x for x in root]
    assert len(set(root)) == 1 and len(pairs) <= rows.count()
    one = sets.withColumn("component", F.lit(0).cast("long"))
    assert op10_jaccard.rare_pairs(one, members, None, 2, rows=rows).count() == 0


def test_sets_below_the_limit_make_no_pairs(spark):
    """Texts of 8 of 12 common pieces share most of their rare shingles, at a similarity of 0.78 at most."""
    rng = random.Random(12)
    chosen = {tuple(sorted(rng.sample(range(12), 8))) for _ in range(60)}
    texts = [" ".join(f"p{k}w{i}" for k in c for i in range(60)) for c in sorted(chosen)]
    sets, members = open_sets(spark, texts)
    assert op10_jaccard.rare_pairs(sets, members, lambda d, *_: d.cache(), 2).count() < 5


def test_keys_of_all_turns_are_all_keys(spark):
    """So a turn's shuffle is a share of the whole, and no key or set is lost or twice."""
    import collections

    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(n)) for n in (1, 3, 5, 40, 200, 200, 900)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    none = op10_jaccard.np.zeros(0, op10_jaccard.np.uint64)
    rows = lambda *turn: collections.Counter((r["key"], r["d1"]) for b in op10_jaccard._keys(none, 80, *turn)([batch]) for r in b.to_pylist())
    whole, turns = rows(), [rows(k, op10_jaccard.KEY_TURNS) for k in range(op10_jaccard.KEY_TURNS)]
    assert sum(turns, collections.Counter()) == whole and len(whole) > 400
    assert len(turns) > 1 and all(len(t) < 0.6 * len(whole) for t in turns)
    assert not {k for k, _ in turns[0]} & {k for k, _ in turns[1]}


def test_documents_that_stay_are_not_joined(spark):
    """Only the ids that go, or repeat, name rows for the join; the rest is neither joined nor shuffled."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(9000)}" for _ in range(30))) for k in range(200)]
    rows += [(1000, rows[3][1]), (1001, rows[4][1] + " more"), (7, rows[7][1]), (None, rows[5][1]), (2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = op10_jaccard.one_of_each(df)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [*range(200), 2000, 2001] and out.filter("doc_id IS NULL").count() == 1
    union = out._jdf.queryExecution().optimizedPlan()
    while "Union" not in union.nodeName():
        union = union.children().apply(0)
    first = union.children().apply(0).toString()
    assert "Join" not in first and "ArrowEvalPython" in first
