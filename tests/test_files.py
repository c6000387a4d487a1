"""Line numbers, result files, stored searches and long chains."""

import gzip
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylochron import cli, shared
from phylochron.operators import diagnostics
from phylochron.plans import orders
from phylochron.plans.rank import rank
from phylochron.sources import lines, newick

SPECIES = "(((A,B)61,(C,D)62)65,(E,F)59)69;"


def test_lines_know_file_and_number(spark, tmp_path):
    (tmp_path / "d").mkdir()
    texts = {"d/b.txt": [f"b{k} x" for k in range(500)], "d/a.txt": ["# head", "", "a1 x", "a2 x"], "z.txt.gz": ["z1 x", "z2 x"], "c.txt": ["c1 x"]}
    for name, rows in texts.items():
        data = ("\n".join(rows) + "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    paths = [str(tmp_path / p) for p in ("z.txt.gz", "d", "c.txt", "d/b.txt")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")  # b.txt is read in several splits
    try:
        got = lines.numbered(spark, *paths).orderBy("ingest_seq").collect()
        want = [(n, k + 1, t) for n in ("z.txt.gz", "d/a.txt", "d/b.txt", "c.txt") for k, t in enumerate(texts[n])]
        assert [(r.line, r.value) for r in got] == [(k, t) for _, k, t in want]
        assert all(r.file.endswith(n) for r, (n, _, _) in zip(got, want, strict=True)) and [r.ingest_seq for r in got] == list(range(len(want)))
        (tmp_path / "d" / "b.txt").write_text("\n".join(["b x"] * 300 + ["b x -3"] + ["b x"] * 50))
        with pytest.raises(Exception, match=r"b\.txt:301: weight is negative"):
            lines.read(spark, *paths).count()
        bad = lines.read(spark, *paths, strict=False).filter("problem IS NOT NULL").collect()
        assert [(r.line, r.problem) for r in bad] == [(301, "weight is negative")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_evidence_is_written_by_tasks(spark, tmp_path):
    rows = [("f2", "A", "B", 1.5, None), ("f1", "C", "D", 2.0, 3.0), (None, "E", "F", 1.0, 0.5)]
    lines.write(spark.createDataFrame(rows, "family string, donor string, receptor string, weight double, distance double"), str(tmp_path / "out"))
    back = lines.read(spark, str(tmp_path / "out"))
    assert {(r.family or None, r.donor, r.receptor, r.weight, r.distance) for r in back.collect()} == set(rows)
    (tmp_path / "t.nwk").write_text(SPECIES)
    (tmp_path / "e.txt").write_text("61 62 3\n62 61 1\n")
    args = [str(tmp_path / "t.nwk"), str(tmp_path / "e.txt"), "-o", str(tmp_path / "cli")]
    assert cli.main(args) == 0 and lines.read(spark, str(tmp_path / "cli")).count() == 2
    assert cli.main(args) == 3 and cli.main([*args, "-f"]) == 0
    for option in ("--searches", "--near-optimal-top-k", "--checkpoint-interval"):
        with pytest.raises(SystemExit):
            cli.main([*args, option, "0"])


def test_text_is_written_whole_or_not(spark, tmp_path):
    path = tmp_path / "sub" / "x.txt"
    shared.write_text(spark, str(path), ["one\n", "two é\n"])
    assert path.read_text() == "one\ntwo é\n" and [p.name for p in path.parent.iterdir()] == ["x.txt"]
    with pytest.raises(FileExistsError):
        shared.write_text(spark, str(path), "three")

    def broken():
        yield "four"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        shared.write_text(spark, str(path), broken(), force=True)
    assert path.read_text() == "one\ntwo é\n" and len(list(path.parent.iterdir())) == 1
    shared.write_text(spark, f"file://{path}", "five", force=True)
    assert path.read_text() == "five" == shared.read_text(spark, str(path))
    # a writer that takes the name after the check is not overwritten

    def late():
        (tmp_path / "y.txt").write_text("other")
        yield "mine"

    with pytest.raises(FileExistsError):
        shared.write_text(spark, str(tmp_path / "y.txt"), late())
    assert (tmp_path / "y.txt").read_text() == "other"


def search_input(spark, scale=1.0):
    nodes = newick.nodes_frame(spark, SPECIES)
    rows = [("61", "62", 3.0), ("62", "61", 1.0), ("59", "62", 2.0), ("59", "61", 1.0), ("62", "59", 2.5)]
    return nodes, spark.createDataFrame([(a, b, w * scale, None, k) for k, (a, b, w) in enumerate(rows)], "donor string, receptor string, weight double, distance double, ingest_seq long")


def test_stored_states_belong_to_one_search(spark, tmp_path):
    nodes, given = search_input(spark)
    folder = str(tmp_path / "states")
    first = rank(spark, nodes, given, iterations=60, temperature=2.0, checkpoint=folder, checkpoint_every=20)
    again = rank(spark, nodes, given.orderBy(F.desc("weight")), iterations=60, temperature=2.0, checkpoint=folder, checkpoint_every=20)
    assert again.order == first.order
    other = search_input(spark, 100.0)[1]
    for changed in ({"evidence": other}, {"seed": 7}, {"temperature": 3.0}):
        kept = {"evidence": given, "seed": 42, "temperature": 2.0} | changed
        with pytest.raises(orders.CheckpointError, match="another"):
            rank(spark, nodes, iterations=60, checkpoint=folder, checkpoint_every=20, **kept)
    # a slice without the mark of its commit is made again
    last = tmp_path / "states" / f"{60:012d}"
    (last / "_SUCCESS").unlink()
    for part in last.glob("part-*"):
        part.write_bytes(b"broken")
    assert rank(spark, nodes, given, iterations=60, temperature=2.0, checkpoint=folder, checkpoint_every=20).order == first.order


def test_a_search_stops_when_told(spark, tmp_path):
    nodes, given = search_input(spark)
    asked = []

    def stop():
        asked.append(time.time())
        return len(asked) > 3

    r = rank(spark, nodes, given, iterations=10**9, temperature=2.0, checkpoint_every=10**9, stop_check=stop, chain_iterations=5)
    assert "stopped after 0 of" in r.warnings[-1] and r.chain is None and set(r.order) == {"61", "62", "65", "59", "69"}
    assert threading.active_count() < 50
    r = rank(spark, nodes, given, iterations=40, temperature=2.0, checkpoint=str(tmp_path / "s"), checkpoint_every=20, stop_check=lambda: False)
    assert not r.warnings


def test_autocorrelation_of_a_long_chain_in_blocks(spark):
    rng, x, energy = random.Random(4), 0.0, []
    for _ in range(3000):
        x = 0.9 * x + rng.gauss(0, 1)
        energy.append(x)
    # the second chain's steps lie far apart: ranks count, not distances
    rows = [(1, k, "s", e) for k, e in enumerate(energy)] + [(2, k * 10**12, "s", e) for k, e in enumerate(energy[:700])] + [(3, 0, "s", 1.0), (4, 0, "s", 2.0), (4, 9, "s", 2.0)]
    rng.shuffle(rows)
    chain = spark.createDataFrame(rows, "chain_id long, step long, state string, energy double")
    for block in (512, 4096):
        got = {(r.chain_id, r.lag): r.rho for r in diagnostics.autocorrelation(chain, 500, block).collect()}
        assert set(got) == {(c, k) for c in (1, 2) for k in range(1, 501)}
        for c, e in ((1, energy), (2, energy[:700])):
            z = np.array(e) - np.mean(e)
            for k in (1, 2, 100, 499, 500):
                assert math.isclose(got[c, k], float(z[:-k] @ z[k:]) / len(z) / z.var(), abs_tol=1e-12)
    ess = {r.chain_id: r.ess for r in diagnostics.effective_samples(chain).collect()}
    assert ess[3] == 1 and ess[4] == 2 and 50 < ess[1] < 400
