"""Trees in Newick form, with labels after `)`, `:length`, NHX annotations in brackets, and `@` as the mark of an ancestor.

One text is one tree of bounded size, so it is read where it is: on the driver for one tree, in the task of its row for
a table of trees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import Problem


class NewickError(ValueError):
    """A text that is no tree; the message tells the position."""


@dataclass
class Node:
    id: int
    parent: int | None
    label: str = ""
    length: float | None = None
    species: str = ""
    is_dup: str = ""
    nd: str = ""
    depth: int = 0
    child_ix: int = 0
    leaf: bool = True


_TOKEN = re.compile(r"""\s*(?:(?P<mark>[(),;])|\[(?P<note>[^\]]*)\]|:(?P<length>[^,();\[\]\s]*)|'(?P<single>[^']*)'|"(?P<double>[^"]*)"|(?P<word>[^(),;:\[\]]+))""")


def parse(text: str) -> list[Node]:
    """The nodes in preorder, ids from 1."""
    nodes: list[Node] = []
    open_nodes: list[Node] = []
    counts: dict[int, int] = {}
    current: Node | None = None
    at, text = 0, text.lstrip("﻿").rstrip()
    if not text:
        raise NewickError("the text is empty")

    def made() -> Node:
        up = open_nodes[-1] if open_nodes else None
        if up is None and nodes:
            raise NewickError(f"a second root at position {at}")
        node = Node(len(nodes) + 1, up.id if up else None, depth=len(open_nodes))
        if up:
            node.child_ix = counts.get(up.id, 0)
            counts[up.id] = node.child_ix + 1
        nodes.append(node)
        return node

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NewickError(f"unexpected {text[at]!r} at position {at}")
        mark = m["mark"]
        if mark == "(":
            if current is not None:
                raise NewickError(f"unexpected '(' at position {m.start('mark')}")
            node = made()
            node.leaf = False
            open_nodes.append(node)
        elif mark in (",", ")"):
            if not open_nodes:
                raise NewickError(f"unexpected {mark!r} at position {m.start('mark')}")
            if current is None:
                made()
            current = None
            if mark == ")":
                current = open_nodes.pop()
        elif mark == ";":
            if open_nodes:
                raise NewickError(f"{len(open_nodes)} parentheses are open at position {m.start('mark')}")
            if text[m.end() :].strip():
                raise NewickError(f"text after ';' at position {m.end()}")
        else:
            current = current or made()
            if m["length"] is not None:
                try:
                    current.length = float(m["length"])
                except ValueError:
                    raise NewickError(f"no length: {m['length']!r} at position {m.start('length')}") from None
            elif m["note"] is not None:
                annotate(current, m["note"])
            else:
                word = next(x for x in (m["single"], m["double"], m["word"]) if x is not None)
                current.label = word.strip().lstrip("@").strip("'\"")
        at = m.end()
    if open_nodes:
        raise NewickError(f"{len(open_nodes)} parentheses are not closed at the end")
    return nodes


def annotate(node: Node, note: str) -> None:
    """The keys S, B, D, Ev and ND of an NHX note; a bare number is a label."""
    for part in note.removeprefix("&&NHX").strip(":").split(":"):
        key, eq, val = part.partition("=")
        if not eq:
            if re.fullmatch(r"[0-9.]+", part) and not node.label:
                node.label = part
        elif key == "S":
            node.species = val
        elif key == "B" and not node.label:
            node.label = val
        elif key == "ND":
            node.nd = val
        elif key == "D":
            node.is_dup = {"Y": "true", "T": "true"}.get(val, "false")
        elif key == "Ev":
            node.is_dup = "true" if val == "GDup" else "false"


def write(nodes: list[Node], nhx: bool = False) -> str:
    """The nodes as Newick text."""
    kids: dict[int | None, list[Node]] = {}
    for n in nodes:
        kids.setdefault(n.parent, []).append(n)
    done: dict[int, str] = {}
    for n in reversed(nodes):
        inner = f"({','.join(done.pop(c.id) for c in kids[n.id])})" if n.id in kids else ""
        note = "".join(f":{k}={v}" for k, v in (("S", n.species), ("ND", n.nd), ("D", {"true": "Y", "false": "N"}.get(n.is_dup, ""))) if v)
        done[n.id] = inner + n.label + ("" if n.length is None else f":{n.length:g}") + (f"[&&NHX{note}]" if nhx and note else "")
    return done[nodes[0].id] + ";"


def problem(nodes: list[Node], edges=()) -> Problem:
    """A kernel instance; fails where the tree is not binary or labels are not unique."""
    check(nodes)
    name = {n.id: n.label for n in nodes}
    return Problem({n.label: name.get(n.parent) for n in nodes}, {n.label for n in nodes if n.leaf}, list(edges))


def check(nodes: list[Node]) -> None:
    """Every internal node has two children; labels are unique and not blank."""
    kids: dict[int, int] = {}
    for n in nodes:
        if n.parent:
            kids[n.parent] = kids.get(n.parent, 0) + 1
    bad = [n.label for n in nodes if not n.leaf and kids.get(n.id, 0) != 2]
    if bad:
        raise NewickError(f"not binary at {bad[:8]}")
    seen: set[str] = set()
    for n in nodes:
        if not n.label.strip() or n.label in seen:
            raise NewickError(f"label {n.label!r} is blank or not unique")
        seen.add(n.label)


ROWS = "node_id int, parent_id int, label string, parent string, is_leaf boolean, length double, child_ix int, depth int, preorder int, species string, is_dup string, nd string"


def rows(nodes: list[Node]) -> list[tuple]:
    name = {n.id: n.label for n in nodes}
    return [(n.id, n.parent, n.label, name.get(n.parent), n.leaf, n.length, n.child_ix, n.depth, n.id, n.species, n.is_dup, n.nd) for n in nodes]


def nodes_frame(spark: SparkSession, text: str) -> DataFrame:
    """The nodes of one tree, lengths null where the text has none."""
    return spark.createDataFrame(rows(parse(text)), ROWS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the tree in a text file, whose lines are joined."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"[\r\n]", "")).first()
    if found is None or not found[0].strip("﻿ "):
        raise NewickError(f"{path} is empty")
    return nodes_frame(spark, found[0])


def trees(texts: DataFrame, key: str = "tree_id", column: str = "newick") -> DataFrame:
    """The nodes of a table of trees: one task reads many trees."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = list(zip(*rows(parse(text)), strict=True))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                names = [x.split()[0] for x in ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cols[0]), b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[key, *names])

    return texts.select(key, column).mapInArrow(run, f"{key} {kind}, {ROWS}")
