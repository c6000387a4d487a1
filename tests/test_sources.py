import gzip
import io
import tarfile

import pytest

from phylochron.plans.rank import InputError, rank
from phylochron.sources import archives, lines, newick, reports

SPECIES = "((A,B)59,((C,D)61,(E,F)62)65)69;"
REPORT = """Reconciliation for Gene Tree 1:
g1: Leaf Node
g2: Leaf Node
m1 = LCA[g1, g2]: Replacing Transfer, Mapping --> 61, Recipient --> 62
m2 = LCA[g1, g2]: Additive Transfer, Mapping --> 62, Recipient --> 65
m3 = LCA[g1, g2]: Speciation, Mapping --> 69
"""


def test_newick_round_trip():
    text = "((a:1,b:2.5)x:3,'c d':1)r[&&NHX:S=s:D=Y];"
    nodes = newick.parse(text)
    assert [n.label for n in nodes] == ["r", "x", "a", "b", "c d"]
    assert nodes[0].species == "s" and nodes[0].is_dup == "true" and nodes[3].length == 2.5
    assert [n.label for n in newick.parse(newick.write(nodes))] == [n.label for n in nodes]


@pytest.mark.parametrize("bad", ["", "((a,b)", "(a,b))r;", "(a:x,b)r;", "(a,b)r;c"])
def test_newick_errors(bad):
    with pytest.raises(newick.NewickError):
        newick.parse(bad)


@pytest.mark.parametrize("bad", ["(a,b,c)r;", "(a,a)r;", "(a,b);"])
def test_tree_checks(bad):
    with pytest.raises(newick.NewickError):
        newick.check(newick.parse(bad))


def test_evidence_files_keep_their_order(spark, tmp_path):
    (tmp_path / "1.txt").write_text("# head\nA B 2\nC D\n")
    (tmp_path / "2.txt").write_text("fam,A,B,3,\n")
    rows = lines.read(spark, str(tmp_path / "1.txt"), str(tmp_path / "2.txt")).orderBy("ingest_seq").collect()
    assert [(r["donor"], r["receptor"], r["weight"], r["family"]) for r in rows] == [("A", "B", 2.0, None), ("C", "D", 1.0, None), ("A", "B", 3.0, "fam")]
    (tmp_path / "3.txt").write_text("A B nan\n")
    with pytest.raises(Exception, match="not finite"):
        lines.read(spark, str(tmp_path / "3.txt")).collect()
    lines.write(lines.read(spark, str(tmp_path / "2.txt")), str(tmp_path / "out"))
    assert lines.read(spark, str(tmp_path / "out")).select("family", "donor", "weight").first() == ("fam", "A", 3.0)


def test_archives():
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w") as tar:
        for name in ("a.txt", "../b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    assert archives.text("x.gz", gzip.compress(b"a\r\nb")) == "a\nb" == archives.text("plain.gz", b"a\rb")
    assert archives.logical_stem("/d/FAM1.uml_rec.gz") == "FAM1"
    with pytest.raises(archives.ArchiveError, match="leaves"):
        list(archives.members("x.tar", packed.getvalue()))


def test_detection():
    assert reports.detect("x.uml_rec.gz", "") == "ale"
    assert reports.detect("f_meanTransfers.txt", "") == "alerax"
    assert reports.detect("x", REPORT) == "artra"
    assert reports.detect("x", REPORT.replace("Replacing ", "").replace("Additive ", "")) == "ranger"
    assert reports.detect("x", "<recPhylo>") == "eccetera" and reports.detect("x", "A B 1") is None


def test_report_to_evidence(spark, tmp_path):
    (tmp_path / "FAM1.txt").write_text(REPORT)
    (tmp_path / "FAM2.txt.gz").write_bytes(gzip.compress((REPORT + "Total number of optimal solutions: 4\n").encode()))
    nodes = newick.nodes_frame(spark, SPECIES)
    report = reports.read(spark, str(tmp_path)).cache()
    got = {(r["family"], r["donor"], r["receptor"]): (r["weight"], r["weight_semantics"]) for r in reports.evidence(report, nodes).collect()}
    assert got == {("FAM1", "61", "62"): (1.0, "integer_count"), ("FAM1", "62", "65"): (1.0, "integer_count"), ("FAM2", "61", "62"): (0.25, "declared_support"), ("FAM2", "62", "65"): (0.25, "declared_support")}
    assert reports.evidence(report, nodes, kinds=("replacing",), min_support=0.5).count() == 1
    assert reports.evidence(report, nodes, min_family=2).count() == 0
    assert reports.only_format(spark, str(tmp_path)) == "artra"


def test_sampled_trees():
    text = "1 reconciled\n\n((A:1,B:1).59.T@61->62:1,C:1).65:1;\n"
    assert [(r[2], r[3]) for r in reports.sampled_rows(text) if r[0] == "transfer"] == [("61", "62")]
    assert [(r[2], r[3]) for r in reports.sampled_rows(text, "rec") if r[0] == "transfer"] == [("65", "59")]


def test_xml_rejects_entities_and_tells_positions():
    with pytest.raises(reports.FormatError, match="declarations"):
        list(reports.xml_rows('<!DOCTYPE x [<!ENTITY a "b">]><recPhylo/>'))
    with pytest.raises(reports.FormatError, match="line 1"):
        list(reports.xml_rows("<recPhylo>"))


def test_rank(spark):
    nodes = newick.nodes_frame(spark, SPECIES.replace(",", ":1,").replace(")", ":1)"))
    rows = [("61", "62", 3.0, None, 1), ("62", "61", 1.0, None, 2), ("59", "62", 2.0, 5.0, 3), ("65", "61", 4.0, None, 4), ("A", "61", 1.0, None, 5)]
    ev = spark.createDataFrame(rows, "donor string, receptor string, weight double, distance double, ingest_seq long")
    r = rank(spark, nodes, ev, iterations=50, random_trees=10)
    assert r.summary["value"] == 1.0 and r.summary["total"] == 11.0 and r.summary["weight_tree_edge"] == 4.0
    assert r.order.index("61") < r.order.index("62") and r.conflicts.count() == 1
    assert r.ranked_newick.endswith("69;") and 0 < r.summary["p_value"] <= 1
    with pytest.raises(InputError, match="does not have"):
        rank(spark, nodes, ev.withColumn("donor", ev["donor"].substr(1, 1)))


def test_stream_equals_batch(spark, tmp_path):
    from phylochron.streaming import edges

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = edges.run_once(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "ck"), "stream_sink")
    want = edges.windowed_weights(edges.events_as_evidence(events))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_ranking_goes_on_from_a_checkpoint(spark, tmp_path):
    from phylochron.sources import synthetic

    nodes, rows = synthetic.instance(spark, 31, 40, 3)
    whole = rank(spark, nodes, rows, iterations=300, temperature=2.0, checkpoint=str(tmp_path / "whole"), checkpoint_every=300)
    rank(spark, nodes, rows, iterations=100, temperature=2.0, checkpoint=str(tmp_path / "parts"), checkpoint_every=100)
    again = rank(spark, nodes, rows, iterations=300, temperature=2.0, checkpoint=str(tmp_path / "parts"), checkpoint_every=100)
    assert again.order == whole.order and again.summary["value"] == whole.summary["value"]
    timed = rank(spark, nodes, rows, iterations=10**9, seconds=0.5)
    assert timed.summary["value"] <= min(timed.summary["value_greedy"], timed.summary["value_mixing"])


def test_search_goes_on_from_stored_states(spark, tmp_path):
    import random

    from phylochron.operators import kernels
    from phylochron.plans import orders
    from phylochron.sources import synthetic

    nodes, rows = synthetic.instance(spark, 63, 60, 3)
    edges = rows.select("donor", "receptor", "weight", rows["ingest_seq"].alias("first_seq")).selectExpr("cast(0 as bigint) AS instance_id", "*").cache()
    assert edges.count() == 60
    states = orders.start_states(edges, nodes, [1, 2])
    for k in range(2):
        orders.advanced(states, edges, nodes, 150, 2.0).write.parquet(str(tmp_path / str(k)))
        states = spark.read.parquet(str(tmp_path / str(k)))
    p = orders._problem(orders.tree_of(nodes), edges.toArrow())
    start = min((kernels.greedy(p)[0], kernels.mixing(p, random.Random(42))), key=lambda o: kernels.value(p, o))
    for r in states.collect():
        want = kernels.search(p, start, 300, 2.0, random.Random(r["seed"]))
        assert r["done"] == 300 and abs(r["best_value"] - want[1]) < 1e-9


def test_cached_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "FAM1.txt").write_text(REPORT)
    nodes, cache = newick.nodes_frame(spark, SPECIES), str(tmp_path / "cache")
    one = reports.cached(spark, cache, nodes, str(tmp_path / "in")).count()
    (tmp_path / "in" / "FAM2.txt").write_text(REPORT)
    assert reports.cached(spark, cache, nodes, str(tmp_path / "in")).count() == 2 * one
    assert spark.read.parquet(cache).count() == 2 * (one + 1)


def test_cache_keeps_equal_names_and_archives_apart(spark, tmp_path):
    for place in ("a", "b"):
        (tmp_path / "in" / place).mkdir(parents=True)
        (tmp_path / "in" / place / "FAM.txt").write_text(REPORT)
    (tmp_path / "in" / "EMPTY.txt").write_text("Recipient -->\n")
    with tarfile.open(tmp_path / "in" / "two.tar", "w") as tar:
        for name in ("X.txt", "Y.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(REPORT)
            tar.addfile(info, io.BytesIO(REPORT.encode()))
    nodes, cache = newick.nodes_frame(spark, SPECIES), str(tmp_path / "cache")
    want = sorted(map(str, reports.read(spark, str(tmp_path / "in")).collect()))
    for _ in range(2):
        assert sorted(map(str, reports.cached(spark, cache, nodes, str(tmp_path / "in")).collect())) == want
    assert spark.read.parquet(cache).filter("row = 'file'").count() == 5  # nothing was parsed twice


def test_reports_in_other_words():
    rows = list(reports.report_rows("Number of equally optimal reconciliations: 7\nhomo sapiens :  leaf  node\nNumber of optimal solutions: 3\n"))
    assert [(r[0], r[2], r[5]) for r in rows] == [("declared", None, 7.0), ("leaf", "homo sapiens", None), ("declared", None, 3.0)]
    with pytest.raises(reports.FormatError, match="declarations"):
        list(reports.xml_rows("<!-- " + "x" * 600 + " --><!DOCTYPE a><recPhylo/>"))
    assert list(reports.xml_rows("<!-- no <!DOCTYPE here --><recPhylo/>")) == []


def test_reconciled_species_of_transfers():
    rec = lambda t: [(r[2], r[3]) for r in reports.sampled_rows(f"1 reconciled\n\n{t}\n", "rec") if r[0] == "transfer"]
    assert rec("((A_1:1,(C_1:1,D_1:1).7:1).T@5->7:1,E_1:1).9:1;") == []  # no child begins in 5
    assert rec("((A_1:1,(C_1:1,D_1:1).7:1).T@A->7:1,E_1:1).9:1;") == [("9", "7")]
    assert rec("(((C_1:1,D_1:1).7:1,A_1:1).T@A->7:1,E_1:1).9:1;") == [("9", "7")]
    assert rec("((A_1:1,((C_1:1,D_1:1).7:1,(C_2:1,D_2:1).8:1).D@7:1).T@A->7:1,E_1:1).9:1;") == [("9", "7"), ("9", "8")]
    assert rec("(((A_1:1,(C_1:1,D_1:1).7:1).T@A->7:1,B_1:1).D@6:1,E_1:1).9:1;") == [("9", "7")]
    assert rec("((A_1:1,(C_1:1,D_1:1).7:1).T@A->7:1,E_1:1).T@1->2:1;") == []  # no species above


def test_closure_of_a_deep_tree(spark):
    from phylochron.operators import trees

    deep = 600
    rows = [(k, k - 1 if k else None, k == deep, 1, k, k) for k in range(deep + 1)]
    nodes = spark.createDataFrame(rows, "label long, parent long, is_leaf boolean, length long, depth long, preorder long")
    got = trees.closure(trees.numbered(nodes))
    assert got.count() == (deep + 1) * (deep + 2) // 2
    assert got.filter("hops <> des - anc OR hops < 0").count() == 0 and got.distinct().count() == got.count()


def test_effective_samples_of_a_slow_chain(spark):
    import math
    import random

    from phylochron.operators import diagnostics

    rng, x, energy = random.Random(4), 0.0, []
    for _ in range(3000):
        x = 0.99 * x + rng.gauss(0, 1)
        energy.append(x)
    mean = sum(energy) / len(energy)
    c = [e - mean for e in energy]
    v, total = sum(a * a for a in c) / len(c), 0.0
    for lag in range(1, 501):
        rho = sum(a * b for a, b in zip(c, c[lag:])) / len(c) / v
        if rho <= 1e-12:
            break
        total += rho
    chain = spark.createDataFrame([(1, k, "s", e) for k, e in enumerate(energy)] + [(2, k, "s", 5.0) for k in range(20)], "chain_id long, step long, state string, energy double")
    got = {r.chain_id: r.ess for r in diagnostics.effective_samples(chain).collect()}
    assert math.isclose(got[1], len(c) / (1 + 2 * total), rel_tol=1e-6) and got[2] == 20 and lag > 50


def test_chain_matches_the_exact_distribution():
    import collections
    import math
    import random

    from phylochron.operators import kernels as k

    p = newick.problem(newick.parse("(((a,b)n4,(c,d)n5)n2,(e,f)n3)n1;"), [("n3", "n4", 2.0), ("n5", "n4", 1.0), ("n2", "n3", 1.5)])
    legal = [tuple(o) for o in k.extensions(p)]
    weight = {o: math.exp(-k.value(p, list(o)) / 2.0) for o in legal}
    seen = collections.Counter(tuple(o) for _, o, _ in k.chain(p, k.greedy(p)[0], 60_000, 2.0, 500, 1, random.Random(11)))
    assert set(seen) == set(legal)
    gap = sum(abs(seen[o] / 60_000 - weight[o] / sum(weight.values())) for o in legal) / 2
    assert gap < 0.02


def test_command_line(spark, tmp_path, capsys):
    from phylochron import cli

    (tmp_path / "t.nwk").write_text(SPECIES)
    (tmp_path / "e.txt").write_text("61 62 3\n62 61 1\n59 62 2\n")
    args = [str(tmp_path / "t.nwk"), str(tmp_path / "e.txt"), "-p", str(tmp_path / "out" / "x"), "--html"]
    assert cli.main([*args, "--dry-run"]) == 0
    assert cli.main(args) == 0 and "best order" in capsys.readouterr().out
    assert (tmp_path / "out" / "x.informative.tsv").read_text() == "61,62 3.0\n59,62 2.0\n62,61 1.0\n"
    assert "<svg" in (tmp_path / "out" / "x.html").read_text()
    assert cli.main(args) == 3 and cli.main([args[0], args[1], *args[1:], "--ls", "0.2", "--t", "1", "--mcmc", "--mcmc-burn-in", "5", "--mcmc-thin", "10", "-f"]) == 0
    assert (tmp_path / "out" / "x.informative.tsv").read_text() == "61,62 3.0\n59,62 2.0\n62,61 1.0\n"  # a path given twice counts once
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and "phylochron 0." in capsys.readouterr().out
    (tmp_path / "e.txt").write_text("61 nowhere 3\n")
    assert cli.main([*args, "-f"]) == 4 and cli.main([*args, "--dry-run"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main([*args, "--threshold-constraints", "2"])
    assert e.value.code == 2
