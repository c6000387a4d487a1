"""The stdout summary, the result files and an HTML page of a ranking. All tables here are of the size of a tree."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import diagnostics
from .plans.rank import Result
from .shared import exists, write_text

SUFFIXES = {"informative": ".informative.tsv", "conflicts": ".conflicts.tsv", "partial_order": ".partial_order.tsv", "random": ".random.tsv"}


def summary_lines(r: Result, source: str) -> list[str]:
    """The figures of a run, in a fixed order."""
    s, total = r.summary, r.summary["total"]
    share = lambda v: f" ({v * 100 / total}%)" if total else ""
    lines = [
        source,
        f"tree with {s['nodes']} internal nodes",
        f"{total} total weight of constraints",
        f"{s['uninformative']} uninformative ({s['weight_desc'] + s['weight_tree_edge']} to a descendant, {s['weight_to_leaf']} to a leaf, {s['weight_anc']} to an ancestor, {s['weight_itself']} to itself, {s['uninformative'] * 100 / total if total else 0:.1f}%)",
    ]
    if s["weight_from_leaf"] > 0:
        lines.append("WARNING: constraints from leaves are ignored in the scores, as only internal nodes are ordered")
    lines += [
        f"{s['trivial_conflict']} trivially conflicting constraints ({int(s['trivial_conflict'] * 100 / total) if total else 0}%)",
        f"value of the order given by the input tree {s['value_input']}{share(s['value_input'])}",
        f"value of the greedy heuristic {s['value_greedy']}{share(s['value_greedy'])}",
        f"value of the mixing heuristic {s['value_mixing']}{share(s['value_mixing'])}",
        f"best order: {s['method']}, {s['value']}{share(s['value'])}",
        r.ranked_newick or "",
        f"similarity of the best order with the input order {s['similarity']}",
        f"{s['ratio']} of the constraints that agree with the best order conflict with the input order",
    ]
    if "random_n" in s:
        lines += [f"p-value of the value over {s['random_n']} random orders {s['p_value']}", f"p-value of the similarity {s['p_similarity']}"]
    return lines + r.warnings


def tables(r: Result) -> dict[str, list[str]]:
    """The lines of the result files, heaviest first, ties by name."""
    ordered = lambda df: df.orderBy(F.desc("weight"), "donor", "receptor").collect()
    out = {
        "informative": [f"{x['donor']},{x['receptor']} {x['weight']}" for x in ordered(r.informative)],
        "conflicts": [f"{x['donor']},{x['receptor']} {x['weight']}" for x in ordered(r.conflicts)],
        "partial_order": [f"{x['donor']} {x['receptor']} {x['weight']} {x['flag']}" for x in ordered(r.partial_order)],
    }
    if r.random is not None:
        out["random"] = [f"{x['value']} {x['similarity']}" for x in r.random.orderBy("order_id").collect()]
    return out


def write_files(r: Result, prefix: str, force: bool = False) -> list[str]:
    """The result files; none is written if one of them exists and force is not given."""
    found = {prefix + SUFFIXES[k]: "".join(x + "\n" for x in v) for k, v in tables(r).items()}
    spark = r.informative.sparkSession
    there = [p for p in found if exists(spark, p)]
    if there and not force:
        raise FileExistsError(f"{', '.join(there)}: exists; force overwrites it")
    for path, text in found.items():
        write_text(spark, path, text, force)
    return list(found)


def bars(counts: dict, title: str) -> str:
    """A bar chart as inline SVG."""
    most, width = max(counts.values(), default=1) or 1, 24
    rects = "".join(f'<rect x="{i * (width + 4)}" y="{100 - 90 * v / most:.1f}" width="{width}" height="{90 * v / most:.1f}"><title>{html.escape(str(k))}: {v}</title></rect>' for i, (k, v) in enumerate(sorted(counts.items())))
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg viewBox="0 0 {len(counts) * (width + 4) or 1} 100" height="120" role="img">{rects}</svg></figure>'


def page(r: Result, source: str, lang: str = "en") -> str:
    """The report as one HTML text; all values are escaped."""
    esc = html.escape
    rows = "".join(f"<tr><td>{esc(k)}</td><td>{esc(str(v))}</td></tr>" for k, v in r.summary.items())
    top = "".join(f"<tr><td>{esc(str(x['donor']))}</td><td>{esc(str(x['receptor']))}</td><td>{x['weight']}</td></tr>" for x in r.informative.orderBy(F.desc("weight"), "donor", "receptor").limit(20).collect())
    hist = {x["bin"]: x["n"] for x in diagnostics.histogram(r.informative, "weight").collect()} if top else {}
    parts = [f"<table>{rows}</table>", bars(hist, "weights of informative constraints"), f"<table><tr><th>donor</th><th>receptor</th><th>weight</th></tr>{top}</table>", "<ol>" + "".join(f"<li>{esc(str(x))}</li>" for x in r.order) + "</ol>"]
    if r.near_optimal is not None:
        near = r.near_optimal.filter("rank > 0").orderBy("value", "seed", "rank").limit(20).collect()
        parts.append("<table><tr><th>value</th><th>visits</th></tr>" + "".join(f"<tr><td>{x['value']}</td><td>{x['visits']}</td></tr>" for x in near) + "</table>")
    if r.chain is not None:
        stats = chain_diagnostics(r.chain).collect()
        parts.append("<p>Samples of a chain whose mixing is not proven.</p><table>" + "".join("<tr>" + "".join(f"<td>{esc(k)}: {esc(str(v))}</td>" for k, v in s.asDict().items()) + "</tr>" for s in stats) + "</table>")
    parts += [f"<p>{esc(w)}</p>" for w in r.warnings]
    return f'<!doctype html><html lang="{esc(lang)}"><meta charset="utf-8"><title>{esc(source)}</title><body><h1>{esc(source)}</h1>{"".join(parts)}</body></html>'


def chain_diagnostics(chain: DataFrame) -> DataFrame:
    """One row a chain: samples, distinct states, duplicates, longest run, energies and effective samples."""
    own = chain.withColumn("energy", F.round("energy", 9))
    return diagnostics.run_stats(own).join(diagnostics.energy_summary(own), "chain_id").join(diagnostics.effective_samples(own), "chain_id")
