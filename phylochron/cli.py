"""phylochron TREE EVIDENCE... : ranks the internal nodes of a tree.

Exit codes: 0 success, 1 a dry run found errors, 2 bad options, 3 a result file exists, 4 bad input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, report
from .operators import evidence as ev
from .operators import trees
from .plans.rank import InputError, rank
from .session import session
from .shared import exists, write_text
from .sources import archives, lines, newick, reports


def parser() -> argparse.ArgumentParser:
    def share(text):
        x = float(text)
        if not 0 <= x <= 1:
            raise argparse.ArgumentTypeError("a share between 0 and 1")
        return x

    def positive(text):
        x = float(text)
        if not 0 <= x < float("inf"):
            raise argparse.ArgumentTypeError("a finite number of at least 0")
        return x

    def count(text, least=0):
        x = int(text)
        if x < least:
            raise argparse.ArgumentTypeError(f"a number of at least {least}")
        return x

    def some(text):
        return count(text, 1)

    p = argparse.ArgumentParser(prog="phylochron", description=__doc__.split("\n")[0])
    p.add_argument("tree")
    p.add_argument("evidence", nargs="+")
    p.add_argument("--version", action="version", version=f"phylochron {__version__}")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--local-search-max-iters", type=count, default=0, help="iterations of each search")
    p.add_argument("--searches", type=some, default=1, help="independent searches, one task each")
    p.add_argument("--local-search", "--ls", type=positive, default=0.0, help="seconds that each search takes at most; 0: no search unless iterations are given")
    p.add_argument("--checkpoint", help="folder of stored search states; a stopped run goes on from there")
    p.add_argument("--checkpoint-interval", type=some, default=1000, help="iterations from one stored state to the next")
    p.add_argument("--temperature", "--t", type=positive)
    p.add_argument("--random-type", "--r", type=int, choices=(0, 1, 2), default=0)
    p.add_argument("--min-transfer-distance", "--d", type=float)
    p.add_argument("--threshold-constraints", "--ts", type=share, default=0.0)
    p.add_argument("--random-trees", "--rd", type=count, default=0)
    p.add_argument("--mcmc", action="store_true", help="a Metropolis chain of 1000 steps, or of --mcmc-iters")
    p.add_argument("--mcmc-iters", type=count, default=0)
    p.add_argument("--mcmc-temperature", type=lambda x: None if x == "auto" else positive(x))
    p.add_argument("--mcmc-burn-in", type=count)
    p.add_argument("--mcmc-thin", type=count)
    p.add_argument("--near-optimal-top-k", type=some, default=10)
    p.add_argument("--target-clade")
    p.add_argument("--target-clade-ancestor-map", action="store_true")
    p.add_argument("--from", dest="tool", choices=("auto", *reports.TOOLS))
    p.add_argument("--from-ale", dest="tool", action="store_const", const="ale")
    p.add_argument("--from-auto", dest="tool", action="store_const", const="auto")
    p.add_argument("--min-support", "--ale-min-support", type=float, default=0.0)
    p.add_argument("--min-family-size", "--ale-min-family-size", type=count, default=0)
    p.add_argument("--transfer-kind", "--artra-transfer-kind", choices=("all", "replacing", "additive"), default="all")
    p.add_argument("--ale-cache-dir", help="folder that keeps the rows of reports; files known there are not parsed again")
    p.add_argument("--quiet-adapters", action="store_true", help="no warnings about reports")
    p.add_argument("--ale-source", choices=("trf", "rec"), default="trf")
    p.add_argument("--min-endpoint-hit-rate", type=share, default=0.5)
    p.add_argument("-o", "--constraints-out", help="write the evidence there, as a folder of text files, and stop")
    p.add_argument("-p", "--output-prefix")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("--html", action="store_true")
    p.add_argument("--no-html", dest="html", action="store_false")
    p.add_argument("--lang", default="en")
    p.add_argument("--dry-run", action="store_true")
    return p


def load(spark: SparkSession, nodes: DataFrame, a) -> DataFrame:
    """The evidence that the options name."""
    if a.tool:
        tool = None if a.tool == "auto" else a.tool
        if tool is None:
            reports.only_format(spark, *a.evidence)
        if a.ale_cache_dir:
            report_rows = reports.cached(spark, a.ale_cache_dir, nodes, *a.evidence, tool=tool, mode=a.ale_source).cache()
        else:
            report_rows = reports.read(spark, *a.evidence, tool=tool, mode=a.ale_source).cache()
        seen = reports.diagnostics(report_rows, nodes).agg(F.sum("transfers_seen").alias("n"), F.sum("transfers_resolved").alias("k")).first()
        if seen["n"] and not seen["k"] and tool not in ("eccetera", None):
            raise InputError("no endpoint of the reports is in the tree")
        if not a.quiet_adapters and seen["n"] and seen["k"] / seen["n"] < a.min_endpoint_hit_rate:
            print(f"WARNING: {seen['k']} of {seen['n']} transfers have both endpoints in the tree", file=sys.stderr)
        return reports.evidence(report_rows, nodes, min_support=a.min_support, min_family=a.min_family_size, kinds=None if a.transfer_kind == "all" else (a.transfer_kind,))
    rows = lines.read(spark, *a.evidence)
    if a.random_type == 1:
        rows = ev.randomize_direction(rows, a.seed)
    elif a.random_type == 2:
        rows = ev.randomize_endpoints(rows, [r[0] for r in nodes.filter("NOT is_leaf").select("label").orderBy("label").collect()], a.seed)
    root = nodes.filter("parent IS NULL").first()["label"]
    return ev.none_to_root(rows, root)


def preflight(spark: SparkSession, a) -> list[tuple[str, str, str]]:
    """(severity, check, detail) of everything that a run would stumble over; empty is fine."""
    out = []
    try:
        nodes = newick.read(spark, a.tree).cache()
    except Exception as e:  # whatever reading the file says is the finding
        return [("error", "tree", str(e).split("\n")[0])]
    out += [("error", "tree", f"{r['kind']} {r['label']!r} ({r['n']})") for r in trees.violations(nodes).limit(20).collect()]
    if a.target_clade and not nodes.filter(F.col("label") == a.target_clade).count():
        out.append(("error", "clade", f"the tree has no node {a.target_clade!r}"))
    if a.tool:
        try:
            if not load(spark, nodes, a).count():
                out.append(("warning", "evidence", "the reports give none"))
        except Exception as e:
            out.append(("error", "reports", str(e).split("\n")[0]))
        return out
    try:
        rows = lines.read(spark, *a.evidence, strict=False)
        out += [("error", "evidence", f"{r['file']}:{r['line']}: {r['problem']}: {r['donor']} {r['receptor']}") for r in rows.filter("problem IS NOT NULL").limit(20).collect()]
        out += [("error", "endpoint", f"{r['label']!r} ({r['n']} times) is not in the tree") for r in ev.unknown_endpoints(rows.filter("problem IS NULL"), nodes).orderBy("label").limit(20).collect()]
        if not rows.count():
            out.append(("warning", "evidence", "there is none"))
    except Exception as e:
        out.append(("error", "evidence", str(e).split("\n")[0]))
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.evidence = list(dict.fromkeys(a.evidence))  # a path that is given twice is read once
    if a.local_search and not a.local_search_max_iters:
        a.local_search_max_iters = 1_000_000_000
    if a.mcmc and not a.mcmc_iters:
        a.mcmc_iters = 1000
    spark = session()
    if a.dry_run:
        found = preflight(spark, a)
        for severity, check, detail in found:
            print(f"{severity}: {check}: {detail}")
        return int(any(s == "error" for s, *_ in found))
    try:
        nodes = newick.read(spark, a.tree)
        newick.check(newick.parse(spark.read.text(a.tree, wholetext=True).first()[0].replace("\n", "")))
        evidence = load(spark, nodes, a)
        if a.constraints_out:
            if exists(spark, a.constraints_out) and not a.force:
                raise FileExistsError(f"{a.constraints_out} exists; force overwrites it")
            lines.write(evidence, a.constraints_out)
            return 0
        r = rank(spark, nodes, evidence, distance=a.min_transfer_distance, threshold=a.threshold_constraints, clade=a.target_clade, map_ancestors=a.target_clade_ancestor_map, seed=a.seed, iterations=a.local_search_max_iters, temperature=a.temperature, searches=a.searches, near_optimal=a.near_optimal_top_k, random_trees=a.random_trees, chain_iterations=a.mcmc_iters, seconds=a.local_search or None, chain_temperature=a.mcmc_temperature, burn_in=a.mcmc_burn_in, thin=a.mcmc_thin, checkpoint=a.checkpoint, checkpoint_every=a.checkpoint_interval)
        prefix = a.output_prefix or archives.logical_path(a.evidence[0])
        report.write_files(r, prefix, a.force)
        if a.html:
            write_text(spark, prefix + ".html", report.page(r, a.evidence[0], a.lang), a.force)
        print("\n".join(report.summary_lines(r, a.evidence[0])))
        return 0
    except FileExistsError as e:
        print(e, file=sys.stderr)
        return 3
    except (ValueError, RecursionError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 4
    except Exception as e:
        if "bad evidence line" not in str(e):
            raise
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(main())
