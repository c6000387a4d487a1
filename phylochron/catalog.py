"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as d
from .operators import diagnostics, evidence, families, graphs, lattice, scoring, trees
from .shared import stored
from .sources import lines

FLAGSHIP = "classify_edges"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = d.SQL):
    """Registers a function as the query of its name; sql follows the common views, derived.SQL or derived.GROWN."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = views + sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# evidence


@query("SELECT donor, receptor, weight, kind FROM classified")
def classify_edges(spark, sf):
    return d.classified(spark, sf).drop("first_seq")


@query("SELECT donor, receptor, weight, first_seq FROM edges")
def edge_weights(spark, sf):
    return d.edges(spark, sf)


@query("SELECT donor, receptor, weight, family, sample, ingest_seq, distance FROM c_raw WHERE distance IS NULL OR distance > 5")
def distance_filter(spark, sf):
    return evidence.distance_filter(d.raw(spark, sf), 5)


@query("""SELECT COUNT(*) AS n_before, COUNT(*) FILTER (distance IS NULL OR distance > 5) AS n_kept,
  COUNT(*) FILTER (distance <= 5) AS n_dropped, COUNT(*) FILTER (distance IS NULL) AS n_unknown,
  COUNT(*) FILTER (distance <= 5 AND donor = receptor) AS n_self_dropped,
  COUNT(*) FILTER (distance <= 5) = 0 AS ignored FROM c_raw""")
def distance_report(spark, sf):
    return evidence.distance_report(d.raw(spark, sf), 5)


@query("""SELECT CAST(CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 1 + l_suppkey % 63 END AS BIGINT) AS donor,
  CAST(1 + l_partkey % 63 AS BIGINT) AS receptor, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2""", "")
def none_endpoint_to_root(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    donor = F.when(F.col("l_suppkey") % 7 == 0, "None").otherwise((1 + F.col("l_suppkey") % 63).cast("string"))
    rows = li.select(donor.alias("donor"), (1 + F.col("l_partkey") % 63).cast("string").alias("receptor"), F.col("l_quantity").cast("long").alias("weight"), F.lit(0).alias("ingest_seq"))
    out = evidence.edge_weights(evidence.none_to_root(rows, "1"))
    return out.select(F.col("donor").cast("long"), F.col("receptor").cast("long"), "weight")


_COIN = "('0x' || substr(md5('7:' || ingest_seq), 1, 8))::BIGINT < 2147483648"


@query(f"""SELECT CASE WHEN {_COIN} THEN receptor ELSE donor END AS donor, CASE WHEN {_COIN} THEN donor ELSE receptor END AS receptor,
  CAST(SUM(weight) AS BIGINT) AS weight FROM c_base GROUP BY 1, 2""")
def randomize_direction(spark, sf):
    return evidence.edge_weights(evidence.randomize_direction(d.raw(spark, sf), 7)).drop("first_seq")


@query("""SELECT one AS donor, 1 + (one - 1 + 1 + ('0x' || substr(md5('7:' || ingest_seq || ':r'), 1, 8))::BIGINT % 30) % 31 AS receptor,
  CAST(SUM(weight) AS BIGINT) AS weight
  FROM (SELECT 1 + ('0x' || substr(md5('7:' || ingest_seq || ':d'), 1, 8))::BIGINT % 31 AS one, ingest_seq, weight FROM c_base) GROUP BY 1, 2""")
def randomize_endpoints(spark, sf):
    return evidence.edge_weights(evidence.randomize_endpoints(d.raw(spark, sf), [int(k) for k in range(1, 32)], 7)).select(F.col("donor").cast("long"), F.col("receptor").cast("long"), "weight")


@query("SELECT kind, COUNT(*) AS n, CAST(SUM(weight) AS BIGINT) AS weight FROM classified GROUP BY 1")
def class_summary(spark, sf):
    return evidence.class_summary(d.classified(spark, sf))


@query("SELECT donor, receptor, weight FROM classified WHERE kind = 'info' AND weight <> 0")
def informative_edges(spark, sf):
    return evidence.informative(d.classified(spark, sf)).drop("first_seq")


@query("""SELECT CAST(SUM(CASE WHEN e.kind = 'anc' THEN e.weight ELSE 0 END + CASE WHEN e.weight >= o.weight THEN o.weight ELSE 0 END) AS BIGINT) AS weight
  FROM classified e LEFT JOIN classified o ON o.donor = e.receptor AND o.receptor = e.donor AND o.kind <> 'tree_edge' WHERE e.kind <> 'tree_edge'""")
def trivial_conflict_weight(spark, sf):
    return evidence.trivial_conflict(d.classified(spark, sf))


@query("SELECT e.donor, e.receptor, e.weight FROM edges e JOIN h ON h.label = e.receptor AND h.parent = e.donor AND NOT h.is_leaf")
def hard_edge_hits(spark, sf):
    return evidence.hard_hits(d.edges(spark, sf), d.nodes(spark)).select("donor", "receptor", "weight")


@query("""SELECT donor, receptor, weight FROM (SELECT *, COALESCE(SUM(weight) OVER (ORDER BY weight, first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  SUM(weight) OVER () AS total FROM edges) WHERE before >= 0.2 * total""")
def threshold_prefix(spark, sf):
    return evidence.threshold(d.edges(spark, sf), 0.2).select("donor", "receptor", "weight")


@query("""SELECT CAST(i AS BIGINT) AS instance_id, COUNT(*) AS n, CAST(SUM(weight) AS BIGINT) AS weight FROM (
  SELECT *, COALESCE(SUM(weight) OVER (ORDER BY weight, first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(weight) OVER () AS total FROM edges
  ), (SELECT unnest(range(0, 11)) AS i) WHERE before * 10 >= i * total GROUP BY 1""")
def threshold_sweep(spark, sf):
    many = d.edges(spark, sf).withColumn("instance_id", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("instance_id", F.col("instance_id").cast("long"))
    by10 = evidence.threshold(many.withColumn("weight", F.col("weight") * 10), F.col("instance_id") / 10, "instance_id")
    return by10.groupBy("instance_id").agg(F.count("*").alias("n"), (F.sum("weight") / 10).cast("long").alias("weight"))


@query("""SELECT donor, receptor, weight, family, sample, ingest_seq, distance FROM c_raw
  WHERE donor IN (SELECT des FROM closure WHERE anc = 5) AND receptor IN (SELECT des FROM closure WHERE anc = 5)""")
def clade_prune(spark, sf):
    return evidence.prune(d.raw(spark, sf), d.tree(spark), 5).select("donor", "receptor", "weight", "family", "sample", "ingest_seq", "distance")


@query("""SELECT donor, receptor, CAST(SUM(weight) AS BIGINT) AS weight FROM (
    SELECT CASE WHEN donor IN (1, 2) THEN 5 ELSE donor END AS donor, CASE WHEN receptor IN (1, 2) THEN 5 ELSE receptor END AS receptor, weight
    FROM c_base WHERE (donor IN (SELECT des FROM closure WHERE anc = 5) OR donor IN (1, 2)) AND (receptor IN (SELECT des FROM closure WHERE anc = 5) OR receptor IN (1, 2)))
  WHERE receptor <> 5 GROUP BY 1, 2""")
def clade_prune_ancestor_map(spark, sf):
    kept = evidence.prune(d.raw(spark, sf), d.tree(spark), F.lit(5).cast("long"), map_ancestors=True)
    return evidence.edge_weights(kept).drop("first_seq")


@query("""SELECT label, COUNT(*) AS n FROM (SELECT donor AS label FROM x UNION ALL SELECT receptor FROM x) GROUP BY 1 HAVING label NOT IN (SELECT label FROM h)""".replace("FROM x", "FROM (SELECT CAST(1 + l_suppkey % 70 AS BIGINT) AS donor, CAST(1 + l_partkey % 70 AS BIGINT) AS receptor FROM lineitem)"))
def unknown_endpoints(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return evidence.unknown_endpoints(li.select((1 + F.col("l_suppkey") % 70).cast("long").alias("donor"), (1 + F.col("l_partkey") % 70).cast("long").alias("receptor")), d.nodes(spark))


@query("""SELECT donor, receptor, CAST(SUM(weight) AS BIGINT) AS weight, MIN(ingest_seq) AS first_seq FROM (
  SELECT *, COALESCE(SUM(weight) OVER (PARTITION BY donor, receptor ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c_base) WHERE before < 400 GROUP BY 1, 2""")
def saturated_weights(spark, sf):
    """Sums that end at a sentinel, here one that about half of the pairs reach."""
    return evidence.saturating_weights(d.raw(spark, sf).drop("distance"), 400)


# lines


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS donor, CAST(l_partkey AS VARCHAR) AS receptor,
  CASE WHEN l_linenumber = 1 THEN 1.0 ELSE l_quantity END AS weight, CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS DOUBLE) END AS distance FROM lineitem""", "")
def parse_space_lines(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = F.concat_ws("  ", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("string")), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("string")))
    return lines.parse(li.select(F.concat(text, F.lit(" # note")).alias("value"))).select("donor", "receptor", "weight", "distance")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS family, CAST(l_suppkey AS VARCHAR) AS donor, CAST(l_partkey AS VARCHAR) AS receptor,
  l_quantity AS weight, CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS DOUBLE) END AS distance FROM lineitem""", "")
def parse_comma_lines(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    last = F.when(F.col("l_linenumber") > 2, F.concat(F.lit(","), F.col("l_linenumber").cast("string"))).when(F.col("l_linenumber") == 2, ",").otherwise("")
    text = F.concat(F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")]), last)
    return lines.parse(li.select(text.alias("value"))).select("family", "donor", "receptor", "weight", "distance")


#: What follows the keys in a line, with what is wrong: a pattern of ?1 and ?2, the two keys.
_BAD = [
    ("?1 ?2 nan", "weight is not finite"), ("?1 ?2 inf", "weight is not finite"), ("?1 ?2 -1", "weight is negative"), ("?1", "fewer than two fields"), ("f,?1,?2", "fewer than four fields"),
    ("f, ,?2,1", "blank endpoint"), ("?1 ?2 x", "weight is no number"), ("f,?1,?2,2,inf", "distance is not finite"), ("?1 ?2 1 far", "distance is no number"), ("?1 ?2 2 3", None),
    ("f,?1,?2,1,", None), ("# ?1", None), ("", None), ("FRQ ?1 ?2", None), ("FRQX ?2 2", None), ("?1 ?2 4 # x", None),
]


@query(f"""SELECT replace(replace(p, '?1', CAST(l_suppkey AS VARCHAR)), '?2', CAST(l_partkey AS VARCHAR)) AS value, problem, COUNT(*) AS n FROM lineitem
  JOIN (VALUES {", ".join(f"({k}, '{p}', '{problem}')" for k, (p, problem) in enumerate(_BAD) if problem)}) v(k, p, problem) ON l_orderkey % {len(_BAD)} = k GROUP BY 1, 2""", "")
def reject_bad_lines(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    pattern = F.element_at(F.array(*[F.lit(p) for p, _ in _BAD]), (1 + F.col("l_orderkey") % len(_BAD)).cast("int"))
    text = F.replace(F.replace(pattern, F.lit("?1"), F.col("l_suppkey").cast("string")), F.lit("?2"), F.col("l_partkey").cast("string"))
    return lines.parse(li.select(text.alias("value"))).filter("problem IS NOT NULL").groupBy("value", "problem").agg(F.count("*").alias("n"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) || '#' || l_linenumber AS line, COUNT(*) AS n FROM lineitem GROUP BY 1""", "")
def strip_inline_comments(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string"), F.lit("\t# said"))
    return li.select(F.rtrim(lines.without_comment(text)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


# trees


@query("SELECT label, parent, is_leaf, length, depth, preorder FROM h", d.GROWN)
def tree_nodes(spark, sf):
    return d.grown(spark, sf)


@query("""SELECT label, depth, rootdist.dist, CAST(row_number() OVER (ORDER BY preorder) - 1 AS BIGINT) AS first, CAST(row_number() OVER (ORDER BY preorder) - 2 + n AS BIGINT) AS last, k AS inner
  FROM h JOIN rootdist USING (label) JOIN (SELECT anc AS label, COUNT(*) AS n, COUNT(*) FILTER (NOT is_leaf) AS k FROM closure JOIN h ON h.label = des GROUP BY 1) USING (label)""", d.GROWN)
def tree_intervals(spark, sf):
    return d.grown_tree(spark, sf).select("label", "depth", "dist", "first", "last", "inner")


@query("""WITH few AS (SELECT CAST(COUNT(*) - 1 + COUNT(*) % 2 AS BIGINT) AS n FROM customer), r AS (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS label, CAST(1 + c_nationkey % 3 AS BIGINT) AS length, n FROM customer, few WHERE c_custkey < n
), up AS (SELECT *, COALESCE(SUM(CASE WHEN label % 2 = 1 AND label > 1 THEN length END) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM r)
  SELECT label, label // 2 AS depth, CAST(CASE WHEN label = 1 THEN 0 ELSE above + length END AS BIGINT) AS dist, label - 1 AS first, CASE WHEN label % 2 = 0 THEN label - 1 ELSE n - 1 END AS last FROM up""", "")
def deep_tree_intervals(spark, sf):
    """A tree half as deep as it has nodes. Its leaves come before the rest of the path, so nodes are numbered by label."""
    return trees.numbered(d.ladder(spark, sf)).select("label", "depth", "dist", "first", "last")


@query("SELECT anc, des, hops FROM closure", d.GROWN)
def ancestor_closure(spark, sf):
    return trees.closure_recursive(d.grown(spark, sf))


@query("SELECT anc, des, hops FROM closure", d.GROWN)
def ancestor_closure_doubling(spark, sf):
    """Pointer doubling makes the intervals that the pairs are read from."""
    return trees.closure(d.grown_tree(spark, sf))


@query("""SELECT p.a, p.b, hops.lca, CAST(x.dist + y.dist - 2 * z.dist AS BIGINT) AS distance, hops.hops
  FROM (SELECT DISTINCT donor AS a, receptor AS b FROM c_base) p JOIN hops ON hops.a = p.a AND hops.b = p.b
  JOIN rootdist x ON x.label = p.a JOIN rootdist y ON y.label = p.b JOIN rootdist z ON z.label = hops.lca""")
def tree_lca_distance(spark, sf):
    pairs = d.raw(spark, sf).select(F.col("donor").alias("a"), F.col("receptor").alias("b")).distinct()
    return trees.distances(pairs, d.tree(spark))


@query("""WITH few AS (SELECT CAST(COUNT(*) - 1 + COUNT(*) % 2 AS BIGINT) AS n FROM customer), p AS (
  SELECT DISTINCT 1 + o_custkey % n AS a, 1 + o_orderkey % n AS b, n FROM orders, few
), up AS (SELECT k AS label, SUM(CASE WHEN k = 1 THEN 0 ELSE length END) AS length FROM (SELECT CAST(c_custkey + 1 AS BIGINT) AS k, 1 + c_nationkey % 3 AS length FROM customer) GROUP BY 1
), path AS (SELECT label, COALESCE(SUM(CASE WHEN label % 2 = 1 THEN length END) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length AS dist FROM up
), l AS (SELECT a, b, CASE WHEN a = b THEN a WHEN greatest(a, b) > least(a, b) AND least(a, b) % 2 = 1 THEN least(a, b) ELSE least(a, b) - 1 END AS lca FROM p)
  SELECT a, b, lca, CAST(x.dist + y.dist - 2 * z.dist AS BIGINT) AS distance, a // 2 + b // 2 - 2 * (lca // 2) AS hops
  FROM l JOIN path x ON x.label = a JOIN path y ON y.label = b JOIN path z ON z.label = lca""", "")
def deep_tree_distances(spark, sf):
    """Distances of pairs that orders name, in a tree half as deep as it has nodes."""
    nodes = d.ladder(spark, sf)
    n = nodes.count()
    pairs = spark.read.parquet(f"{sf}/orders.parquet").select((1 + F.col("o_custkey") % n).alias("a"), (1 + F.col("o_orderkey") % n).alias("b")).distinct()
    return trees.distances(pairs, trees.numbered(nodes))


@query("SELECT anc AS label, des AS leaf FROM closure JOIN h ON h.label = des AND h.is_leaf", d.GROWN)
def leaves_under(spark, sf):
    return trees.leaves_under(d.grown_tree(spark, sf))


@query(""", more AS (SELECT label, parent, is_leaf FROM h UNION ALL SELECT label + CASE WHEN label % 4 = 0 THEN 0 ELSE 100000000 END, parent // 2, TRUE FROM h WHERE label % 8 IN (4, 5) AND parent > 1),
  kids AS (SELECT parent, COUNT(*) AS n FROM more WHERE parent IS NOT NULL GROUP BY 1 HAVING COUNT(*) <> 2)
  SELECT 'not binary' AS kind, CAST(parent AS VARCHAR) AS label, n FROM kids
  UNION ALL SELECT CASE WHEN is_leaf THEN 'leaf label' ELSE 'internal label' END, CAST(label AS VARCHAR), COUNT(*) FROM more GROUP BY is_leaf, label HAVING COUNT(*) > 1""", d.GROWN)
def tree_violations(spark, sf):
    """The tree of suppliers with leaves hung on where there are two children already, half of them with labels that exist."""
    nodes = d.grown(spark, sf).select("label", "parent", "is_leaf")
    label = F.col("label") + F.when(F.col("label") % 4 == 0, F.lit(0)).otherwise(F.lit(100000000))
    more = nodes.filter("label % 8 IN (4, 5) AND parent > 1").select(label.alias("label"), F.shiftright("parent", 1).alias("parent"), F.lit(True).alias("is_leaf"))
    return trees.violations(nodes.unionByName(more))


@query("""SELECT substr(sha256(string_agg(CAST(label AS VARCHAR), '|' ORDER BY CAST(label AS VARCHAR))), 1, 16) AS labels_digest,
  substr(sha256(string_agg(parent || '>' || label, '|' ORDER BY parent || '>' || label) FILTER (parent IS NOT NULL)), 1, 16) AS topology_digest FROM h""", d.GROWN)
def topology_digest(spark, sf):
    return trees.topology_digest(d.grown(spark, sf))


@query(""", leaves AS (SELECT label, CAST(row_number() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS BIGINT) AS num FROM h WHERE is_leaf),
  up AS (SELECT anc AS label, MAX(hops) AS level, MIN(num) AS first FROM closure LEFT JOIN leaves ON leaves.label = des JOIN h ON h.label = anc AND NOT h.is_leaf GROUP BY 1)
  SELECT label, num FROM leaves UNION ALL
  SELECT label, CAST((SELECT COUNT(*) FROM leaves) + row_number() OVER (ORDER BY level, first, CAST(label AS VARCHAR)) - 1 AS BIGINT) FROM up""", d.GROWN)
def numeric_id_map(spark, sf):
    return trees.numeric_ids(d.grown_tree(spark, sf))


@query("SELECT COUNT(*) AS n, ROUND(lgamma(COUNT(*) + 1) - SUM(ln(s)), 5) AS log_count FROM (SELECT anc, COUNT(*) AS s FROM closure JOIN h ON h.label = des AND NOT h.is_leaf GROUP BY 1)", d.GROWN)
def linear_extension_count(spark, sf):
    return trees.extension_count_log(d.grown_tree(spark, sf)).withColumn("log_count", F.round("log_count", 5))


# graphs and state spaces

_LINKS = """links AS (SELECT parent AS src, label AS dst FROM h WHERE parent IS NOT NULL AND NOT is_leaf
    UNION SELECT s_suppkey + 1, s_suppkey + 1 + gap + s_nationkey FROM supplier, (VALUES {gaps}) g(gap)
    WHERE s_suppkey + 1 IN (SELECT label FROM h WHERE NOT is_leaf) AND s_suppkey + 1 + gap + s_nationkey IN (SELECT label FROM h WHERE NOT is_leaf)),
  ways AS (WITH RECURSIVE w(src, dst) AS (SELECT src, dst FROM links UNION SELECT w.src, l.dst FROM w JOIN links l ON w.dst = l.src) SELECT * FROM w)"""


@query(f", {_LINKS.format(gaps='(20)')} SELECT src, dst FROM ways", d.GROWN)
def graph_closure(spark, sf):
    """What the tree of suppliers and an accepted edge from each supplier reach."""
    return graphs.reach(graphs.accepted(d.grown(spark, sf), d.supplier_links(spark, sf, 20)))


@query(f", {_LINKS.format(gaps='(20), (1)')} SELECT src, dst FROM ways", d.GROWN)
def graph_closure_extended(spark, sf):
    """The same with edges accepted later."""
    known = graphs.closed(graphs.accepted(d.grown(spark, sf), d.supplier_links(spark, sf, 20)))
    later = d.supplier_links(spark, sf, 1).select(F.col("donor").alias("src"), F.col("receptor").alias("dst"))
    return graphs.pairs(*graphs.more(*known, later))


@query("""SELECT receptor AS label, COUNT(*) AS donors, CAST(SUM(weight) AS BIGINT) AS weight, arg_min(donor, (-weight, donor)) AS heaviest FROM edges WHERE donor <> receptor GROUP BY 1""")
def in_neighbours(spark, sf):
    return graphs.in_neighbours(d.edges(spark, sf))


_SPACE = """perms AS (WITH RECURSIVE p(o) AS (SELECT [CAST(1 AS BIGINT)] UNION ALL
    SELECT list_append(o, k) FROM p, (SELECT unnest(range(2, 7)) AS k) WHERE NOT list_contains(o, k) AND list_contains(o, k // 2)) SELECT o FROM p WHERE len(o) = 6),
  small AS (SELECT l_suppkey AS instance_id, 1 + l_partkey % 6 AS donor, 1 + l_orderkey % 6 AS receptor, SUM(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2, 3),
  space AS (SELECT CAST(s_suppkey AS BIGINT) AS instance_id, array_to_string(o, ',') AS state,
    COALESCE(SUM(w) FILTER (list_position(o, donor) > list_position(o, receptor)), 0)::DOUBLE AS energy FROM supplier CROSS JOIN perms LEFT JOIN small ON instance_id = s_suppkey GROUP BY s_suppkey, o),
  shares AS (SELECT *, exp((MIN(energy) OVER (PARTITION BY instance_id) - energy) / 500) AS e FROM space)"""


@query(f""", {_SPACE} SELECT instance_id, CAST(6 AS BIGINT) AS nodes, COUNT(*)::DOUBLE AS orders, MIN(energy) AS best, ROUND(ln(SUM(e)) - MIN(energy) / 500, 6) AS log_mass FROM shares GROUP BY 1""")
def state_space_totals(spark, sf):
    return lattice.totals(*d.small_instances(spark, sf), 500.0).withColumn("orders", F.col("orders").cast("double")).withColumn("log_mass", F.round("log_mass", 6))


@query(f""", {_SPACE} SELECT instance_id, state, energy, ROUND(e / SUM(e) OVER (PARTITION BY instance_id), 9) AS share FROM shares""")
def state_space(spark, sf):
    return lattice.orders(*d.small_instances(spark, sf), 500.0).withColumn("share", F.round("share", 9))


@query(f""", {_SPACE}, numbered AS (SELECT instance_id, state, e / SUM(e) OVER (PARTITION BY instance_id) AS share, row_number() OVER (PARTITION BY instance_id ORDER BY state) - 1 AS k FROM shares),
  drawn AS (SELECT l_suppkey AS instance_id, (l_partkey * 7 + l_linenumber) % 23 AS k, COUNT(*) AS seen FROM lineitem GROUP BY 1, 2)
  SELECT COALESCE(n.instance_id, r.instance_id) AS instance_id, CAST(SUM(seen) AS BIGINT) AS samples, COUNT(*) FILTER (seen IS NOT NULL AND share IS NOT NULL) AS visited,
    CAST(COALESCE(SUM(seen) FILTER (share IS NULL), 0) AS BIGINT) AS unknown, COUNT(share) AS states,
    ROUND(SUM(abs(COALESCE(seen, 0) / total - COALESCE(share, 0))) / 2, 6) AS distance
  FROM numbered n FULL JOIN drawn r ON n.instance_id = r.instance_id AND n.k = r.k JOIN (SELECT instance_id AS i, SUM(seen)::DOUBLE AS total FROM drawn GROUP BY 1) ON i = COALESCE(n.instance_id, r.instance_id) GROUP BY 1""")
def sampled_states(spark, sf):
    """States drawn by line items, some of which are none, against the exact distribution."""
    from pyspark.sql import Window

    space = lattice.orders(*d.small_instances(spark, sf), 500.0)
    number = space.select("instance_id", "state", (F.row_number().over(Window.partitionBy("instance_id").orderBy("state")) - 1).cast("long").alias("k"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("instance_id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 23).cast("long").alias("k"))
    drawn = li.join(number, ["instance_id", "k"], "left").select("instance_id", F.coalesce("state", F.concat(F.lit("none "), F.col("k").cast("string"))).alias("state"))
    return lattice.visited(drawn, space).withColumn("distance", F.round("distance", 6))


# orders

_VALUE = "CAST(COALESCE(SUM(CASE WHEN p.pos > q.pos THEN weight ELSE 0 END), 0) AS BIGINT)"


@query("SELECT order_id, label, pos FROM input_pos", d.GROWN)
def input_order(spark, sf):
    return d.input_positions(spark, d.grown_tree(spark, sf))


@query(f"SELECT p.order_id, {_VALUE} AS value FROM edges JOIN input_pos p ON p.label = donor JOIN input_pos q ON q.label = receptor GROUP BY 1")
def value_of_order(spark, sf):
    return scoring.values(d.edges(spark, sf), d.input_positions(spark))


@query("SELECT p.order_id, donor, receptor, weight FROM edges JOIN input_pos p ON p.label = donor JOIN input_pos q ON q.label = receptor WHERE p.pos > q.pos")
def conflicts_table(spark, sf):
    return scoring.conflicts(d.edges(spark, sf), d.input_positions(spark))


_PARTIAL = """partial AS (SELECT donor, receptor, weight, CASE WHEN i.pos > j.pos THEN 'green' ELSE 'black' END AS flag
  FROM classified JOIN hash_pos p ON p.label = donor AND p.order_id = 3 JOIN hash_pos q ON q.label = receptor AND q.order_id = 3
  JOIN input_pos i ON i.label = donor JOIN input_pos j ON j.label = receptor WHERE kind = 'info' AND weight <> 0 AND p.pos < q.pos)"""


def _partial(spark, sf):
    return scoring.partial_order(evidence.informative(d.classified(spark, sf)), d.hash_positions(spark).filter("order_id = 3"), d.input_positions(spark))


@query(f", {_PARTIAL} SELECT donor, receptor, weight, flag FROM partial")
def partial_order_table(spark, sf):
    return _partial(spark, sf)


@query(f""", {_PARTIAL} SELECT CAST(SUM(weight) AS BIGINT) AS kept, CAST(SUM(CASE WHEN flag = 'green' THEN weight ELSE 0 END) AS BIGINT) AS against_reference,
  ROUND(SUM(CASE WHEN flag = 'green' THEN weight ELSE 0 END)::DOUBLE / SUM(weight)::DOUBLE, 6) AS ratio FROM partial""")
def conflict_ratio(spark, sf):
    return scoring.conflict_ratio(_partial(spark, sf))


@query("""SELECT p.order_id, CAST(COUNT(*) FILTER (p.pos > q.pos) AS BIGINT) AS violated FROM closure JOIN hash_pos p ON p.label = anc
  JOIN hash_pos q ON q.label = des AND q.order_id = p.order_id WHERE hops > 0 GROUP BY 1""", d.GROWN)
def order_is_legal(spark, sf):
    tree = d.grown_tree(spark, sf)
    return scoring.legality(d.hash_positions(spark, of=tree), tree)


_SHUFFLED = """turned AS (SELECT order_id, label, CAST(row_number() OVER (PARTITION BY order_id ORDER BY ('0x' || substr(md5(order_id || '/' || label), 1, 8))::BIGINT, label) - 1 AS BIGINT) AS pos
  FROM (SELECT unnest(range(0, 20)) AS order_id), h WHERE NOT is_leaf)"""


def _shuffled(spark, tree):
    """Orders that heed no tree: internal nodes by a coin of order and label."""
    from pyspark.sql import Window

    toss = evidence.hashed("/", "order_id", "label")
    rows = spark.range(20).select(F.col("id").alias("order_id")).crossJoin(tree.filter("NOT is_leaf").select("label"))
    return rows.select("order_id", "label", (F.row_number().over(Window.partitionBy("order_id").orderBy(toss, "label")) - 1).cast("long").alias("pos"))


@query(f""", {_SHUFFLED} SELECT p.order_id, CAST(COUNT(*) FILTER (p.pos > q.pos) AS BIGINT) AS violated FROM closure JOIN turned p ON p.label = anc
  JOIN turned q ON q.label = des AND q.order_id = p.order_id WHERE hops > 0 GROUP BY 1""", d.GROWN)
def order_violations(spark, sf):
    tree = d.grown_tree(spark, sf)
    return scoring.legality(_shuffled(spark, tree), tree)


@query(""", m AS (SELECT order_id, CASE WHEN label % 11 = order_id % 11 THEN label + 1 ELSE label END AS label, CASE WHEN label % 7 = 3 THEN pos + order_id - 10 ELSE pos END AS pos FROM hash_pos WHERE (label + order_id) % 13 <> 5),
  t AS (SELECT order_id, COUNT(DISTINCT CASE WHEN NOT h.is_leaf THEN m.label END) AS have, COUNT(*) FILTER (h.label IS NULL) AS unknown, MIN(pos) AS low, MAX(pos) AS high, (SELECT COUNT(*) FROM h WHERE NOT is_leaf) AS size
    FROM m LEFT JOIN h ON h.label = m.label AND NOT h.is_leaf GROUP BY 1), all_of AS (
  SELECT order_id, 'unknown label' AS problem, unknown AS n FROM t UNION ALL SELECT order_id, 'missing label', size - have FROM t
  UNION ALL SELECT order_id, 'position out of range', CAST(CASE WHEN low < 0 THEN 1 ELSE 0 END + CASE WHEN high >= size THEN 1 ELSE 0 END AS BIGINT) FROM t
  UNION ALL SELECT order_id, 'repeated label', COUNT(*) - COUNT(DISTINCT label) FROM m GROUP BY 1
  UNION ALL SELECT order_id, 'repeated position', COUNT(*) - COUNT(DISTINCT pos) FROM m GROUP BY 1) SELECT order_id, problem, n FROM all_of WHERE n > 0""", d.GROWN)
def malformed_orders(spark, sf):
    """Orders with labels changed and left out and positions moved, and what is wrong with each."""
    pos = d.hash_positions(spark, of=d.grown_tree(spark, sf)).filter("(label + order_id) % 13 <> 5")
    label = F.when(F.col("label") % 11 == F.col("order_id") % 11, F.col("label") + 1).otherwise(F.col("label"))
    place = F.when(F.col("label") % 7 == 3, F.col("pos") + F.col("order_id") - 10).otherwise(F.col("pos"))
    return scoring.malformed(pos.select("order_id", label.alias("label"), place.alias("pos")), d.grown(spark, sf))


_KENDALL = """kendall AS (SELECT a.order_id, CAST(COUNT(*) FILTER (i.pos > j.pos) AS BIGINT) AS distance FROM hash_pos a JOIN hash_pos b ON a.order_id = b.order_id AND a.pos < b.pos
  JOIN input_pos i ON i.label = a.label JOIN input_pos j ON j.label = b.label GROUP BY 1)"""


@query(f", {_KENDALL} SELECT order_id, distance FROM kendall", d.GROWN)
def kendall_distance(spark, sf):
    tree = d.grown_tree(spark, sf)
    return scoring.kendall_distance(d.hash_positions(spark, of=tree), d.input_positions(spark, tree))


_MOST = "((SELECT COUNT(*) * (COUNT(*) - 1) // 2 FROM h WHERE NOT is_leaf) - (SELECT COUNT(*) FROM closure JOIN h ON h.label = des AND NOT h.is_leaf WHERE hops > 0))"


@query(f", {_KENDALL} SELECT order_id, ROUND(({_MOST} - distance)::DOUBLE / {_MOST}, 6) AS similarity FROM kendall", d.GROWN)
def kendall_similarity(spark, sf):
    tree = d.grown_tree(spark, sf)
    return scoring.kendall_similarity(d.hash_positions(spark, of=tree), d.input_positions(spark, tree), tree).withColumn("similarity", F.round("similarity", 6))


_SCORED = f"scored AS (SELECT p.order_id, {_VALUE} AS value FROM edges JOIN hash_pos p ON p.label = donor JOIN hash_pos q ON q.label = receptor AND q.order_id = p.order_id GROUP BY 1)"


@query(f", {_SCORED} SELECT order_id, value FROM scored")
def random_orders_scored(spark, sf):
    return scoring.values(d.edges(spark, sf), d.hash_positions(spark))


@query(f""", {_SCORED}, {_KENDALL}, own AS (SELECT {_VALUE} AS v FROM edges JOIN input_pos p ON p.label = donor JOIN input_pos q ON q.label = receptor)
  SELECT COUNT(*) AS n, ROUND((COUNT(*) FILTER (value <= v) + 1)::DOUBLE / (COUNT(*) + 1), 6) AS p_value,
  ROUND((COUNT(*) FILTER (({_MOST} - distance)::DOUBLE / {_MOST} >= 0.5) + 1)::DOUBLE / (COUNT(*) + 1), 6) AS p_similarity FROM scored JOIN kendall USING (order_id), own""")
def permutation_pvalue(spark, sf):
    tree, edges = d.tree(spark), stored(d.edges(spark, sf), "edges")
    pos, ref = stored(d.hash_positions(spark, of=tree), "positions"), d.input_positions(spark, tree)
    own = scoring.values(edges, ref).select(F.col("value").alias("v"))
    both = scoring.values(edges, pos).join(scoring.kendall_similarity(pos, ref, tree), "order_id").join(F.broadcast(own))  # one row
    out = scoring.permutation_test(both, F.col("v"), 0.5)
    return out.select("n", F.round("p_value", 6).alias("p_value"), F.round("p_similarity", 6).alias("p_similarity"))


@query(f", {_SCORED} SELECT order_id, value, CAST(row_number() OVER (ORDER BY value, order_id) AS BIGINT) AS rank FROM scored ORDER BY value, order_id LIMIT 5")
def near_optimal_topk(spark, sf):
    return scoring.near_optimal(scoring.values(d.edges(spark, sf), d.hash_positions(spark)), 5)


@query("SELECT label, pos, COUNT(*) AS n FROM hash_pos GROUP BY 1, 2", d.GROWN)
def node_position_frequency(spark, sf):
    return scoring.position_frequency(d.hash_positions(spark, of=d.grown_tree(spark, sf)))


_PAIRS = "pairs AS (SELECT p.label AS a, q.label AS b, COUNT(*) FILTER (p.pos < q.pos) AS n_before, COUNT(*) AS n FROM hash_pos p JOIN hash_pos q ON p.order_id = q.order_id AND p.label < q.label GROUP BY 1, 2)"


@query(f", {_PAIRS} SELECT a, b, n_before, n FROM pairs", d.GROWN)
def pair_order_frequency(spark, sf):
    return scoring.pair_frequency(d.hash_positions(spark, of=d.grown_tree(spark, sf)))


@query(f", {_PAIRS} SELECT a, b, n_before, n FROM pairs WHERE n_before IN (0, n) AND NOT EXISTS (SELECT 1 FROM closure WHERE hops > 0 AND least(anc, des) = a AND greatest(anc, des) = b)", d.GROWN)
def constant_direction_pairs(spark, sf):
    tree = d.grown_tree(spark, sf)
    return scoring.constant_order_pairs(d.hash_positions(spark, of=tree), tree)


@query(f""", moved AS (SELECT label, CASE WHEN label = 20 THEN 25 WHEN pos > o AND pos <= 25 THEN pos - 1 WHEN pos < o AND pos >= 25 THEN pos + 1 ELSE pos END AS pos
    FROM input_pos, (SELECT pos AS o FROM input_pos WHERE label = 20))
  SELECT CAST((SELECT {_VALUE} FROM edges JOIN moved p ON p.label = donor JOIN moved q ON q.label = receptor)
  - (SELECT {_VALUE} FROM edges JOIN input_pos p ON p.label = donor JOIN input_pos q ON q.label = receptor) AS BIGINT) AS delta""")
def incremental_move_delta(spark, sf):
    return scoring.move_delta(d.edges(spark, sf), d.input_positions(spark), 20, 25)


@query(f"""SELECT CAST(SUM(weight) AS BIGINT) AS total, (SELECT {_VALUE} FROM edges JOIN input_pos p ON p.label = donor JOIN input_pos q ON q.label = receptor) AS violated,
  (SELECT {_VALUE.replace('p.pos > q.pos', 'p.pos <= q.pos')} FROM edges JOIN input_pos p ON p.label = donor JOIN input_pos q ON q.label = receptor) AS kept FROM edges""")
def delivered_value_check(spark, sf):
    edges = d.edges(spark, sf)
    at = scoring.located(edges, d.input_positions(spark))
    bad = F.col("donor_pos") > F.col("receptor_pos")
    split = at.agg(F.sum(F.when(bad, F.col("weight")).otherwise(0)).alias("violated"), F.sum(F.when(~bad, F.col("weight")).otherwise(0)).alias("kept"))
    return edges.agg(F.sum("weight").alias("total")).join(split)


# families

_FAMILY = "fam AS (SELECT family, donor, receptor, COUNT(*) AS weight FROM c_base GROUP BY 1, 2, 3)"
_SIZE = "size AS (SELECT family, COUNT(DISTINCT sample) + family % 5 AS size FROM c_base GROUP BY 1)"


def _sizes(spark, sf):
    return d.raw(spark, sf).groupBy("family").agg((F.count_distinct("sample") + F.first("family") % 5).alias("size"))


@query(f", {_FAMILY} SELECT family, donor, receptor, weight FROM fam")
def family_edge_counts(spark, sf):
    return families.counts(d.raw(spark, sf))


@query(f""", {_FAMILY} SELECT f.family, f.donor, f.receptor, CAST(CASE WHEN f.donor = f.receptor THEN f.weight ELSE greatest(f.weight - COALESCE(o.weight, 0), 0) END AS BIGINT) AS net
  FROM fam f LEFT JOIN fam o ON o.family = f.family AND o.donor = f.receptor AND o.receptor = f.donor""")
def reciprocal_subtract(spark, sf):
    return families.net_counts(families.counts(d.raw(spark, sf))).select("family", "donor", "receptor", "net")


@query(f", {_SIZE} SELECT family, COUNT(*) AS n FROM c_base JOIN size USING (family) WHERE size > 9 GROUP BY 1")
def family_size_filter(spark, sf):
    return families.larger_families(d.raw(spark, sf), _sizes(spark, sf), 9).groupBy("family").agg(F.count("*").alias("n"))


@query(f""", {_FAMILY} SELECT family, donor, receptor, ROUND(weight::DOUBLE / (CASE WHEN family % 3 = 0 THEN 1 ELSE 7 END), 6) AS weight,
  CASE WHEN family % 3 = 0 THEN 'integer_count' ELSE 'sample_support' END AS weight_semantics FROM fam WHERE weight::DOUBLE / (CASE WHEN family % 3 = 0 THEN 1 ELSE 7 END) > 0.2""")
def support_semantics(spark, sf):
    by = families.counts(d.raw(spark, sf))
    given = by.select("family").distinct().filter("family % 3 <> 0").withColumn("denominator", F.lit(7).cast("long"))
    return families.supported(by, given, 0.2).select("family", "donor", "receptor", F.round("weight", 6).alias("weight"), "weight_semantics")


@query("""SELECT COUNT(*) AS seen, COUNT(*) FILTER (donor <= 40 AND receptor <= 40) AS resolved, ROUND(COUNT(*) FILTER (donor <= 40 AND receptor <= 40)::DOUBLE / COUNT(*), 6) AS rate FROM c_base""")
def endpoint_hit_rate(spark, sf):
    return families.hit_rate(d.raw(spark, sf), d.nodes(spark).filter("label <= 40"))


@query("SELECT p.parent AS donor, receptor, CAST(SUM(weight) AS BIGINT) AS weight FROM c_base JOIN h p ON p.label = donor AND p.parent IS NOT NULL JOIN h r ON r.label = receptor AND NOT r.is_leaf GROUP BY 1, 2")
def parent_of_donor(spark, sf):
    return evidence.edge_weights(families.parent_of_donor(d.raw(spark, sf), d.nodes(spark))).drop("first_seq")


@query("SELECT donor, receptor, CAST(SUM(weight) AS BIGINT) AS weight FROM (SELECT donor, receptor, weight FROM c_base UNION ALL SELECT receptor, donor, weight FROM c_base WHERE sample = 2) GROUP BY 1, 2")
def merge_sources(spark, sf):
    raw = d.raw(spark, sf)
    other = raw.filter("sample = 2").select(F.col("receptor").alias("donor"), F.col("donor").alias("receptor"), "weight", "ingest_seq")
    return evidence.edge_weights(evidence.merge_sources(raw.select("donor", "receptor", "weight", "ingest_seq"), other)).drop("first_seq")


@query("""SELECT CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(w) AS BIGINT) AS w, (SELECT array_to_string(list_sort(list_distinct(list(CAST(donor AS VARCHAR)))), ' ') FROM c_base WHERE donor % 9 = 0) AS labels
  FROM (SELECT family, COUNT(*) AS n, SUM(weight) AS w FROM c_base GROUP BY 1)""")
def diagnostics_rollup(spark, sf):
    per = d.raw(spark, sf).groupBy("family").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.collect_set(F.when(F.col("donor") % 9 == 0, F.col("donor").cast("string"))).alias("labels"))
    return families.rollup(per, ["n", "w"], ["labels"]).withColumn("labels", F.array_join("labels", " "))


# chains and samples


@query("""SELECT chain_id, CAST(SUM(len) AS BIGINT) AS samples, CAST(SUM(len - 1) AS BIGINT) AS duplicates, MAX(len) AS longest_run, (SELECT COUNT(DISTINCT state) FROM chain c WHERE c.chain_id = r.chain_id) AS distinct_states FROM (
  SELECT chain_id, g, COUNT(*) AS len FROM (SELECT chain_id, step, row_number() OVER (PARTITION BY chain_id ORDER BY step) - row_number() OVER (PARTITION BY chain_id, state ORDER BY step) AS k, state,
  state || ':' || k AS g FROM chain) GROUP BY 1, 2) r GROUP BY 1""")
def chain_run_stats(spark, sf):
    return diagnostics.run_stats(d.chain(spark, sf))


@query("SELECT chain_id, energy, COUNT(*) AS n FROM chain GROUP BY 1, 2")
def energy_histogram(spark, sf):
    return diagnostics.energy_histogram(d.chain(spark, sf))


@query("SELECT chain_id, ROUND(AVG(energy), 6) AS mean, MIN(energy) AS low, MAX(energy) AS high, ROUND(stddev_pop(energy), 6) AS sd FROM chain GROUP BY 1")
def energy_summary(spark, sf):
    return diagnostics.energy_summary(d.chain(spark, sf))


@query(""", m AS (SELECT chain_id, AVG(energy) AS m, var_pop(energy) AS v, COUNT(*) AS n FROM chain GROUP BY 1),
  x AS (SELECT chain_id, (step - chain_id) // 4 AS t, energy - m AS x, v, n FROM chain JOIN m USING (chain_id)),
  rho AS (SELECT a.chain_id, k AS lag, SUM(a.x * b.x) / any_value(a.n) / any_value(a.v) AS rho FROM x a, (SELECT unnest(range(1, 501)) AS k), x b WHERE b.chain_id = a.chain_id AND b.t = a.t + k GROUP BY 1, 2),
  stop AS (SELECT chain_id, MIN(lag) AS stop FROM rho WHERE rho <= 1e-12 GROUP BY 1)
  SELECT m.chain_id, ROUND(n / (1 + 2 * COALESCE((SELECT SUM(rho) FROM rho WHERE rho.chain_id = m.chain_id AND lag < COALESCE((SELECT stop FROM stop WHERE stop.chain_id = m.chain_id), 999)), 0)), 6) AS ess FROM m""")
def autocovariance_ess(spark, sf):
    return diagnostics.effective_samples(d.chain(spark, sf).withColumn("step", ((F.col("step") - F.col("chain_id")) / 4).cast("long")))


@query(""", o AS (SELECT chain_id, energy, row_number() OVER (PARTITION BY chain_id ORDER BY step) - 1 AS k, COUNT(*) OVER (PARTITION BY chain_id) // 10 AS m FROM chain)
  SELECT chain_id, CAST(k // m AS BIGINT) AS batch, ROUND(AVG(energy), 6) AS mean FROM o WHERE k // m < 10 GROUP BY 1, 2""")
def batch_means(spark, sf):
    return diagnostics.batch_means(d.chain(spark, sf))


@query(""", r AS (SELECT MIN(weight) AS lo, MAX(weight) AS hi FROM edges)
  SELECT CAST(least(11, floor((weight - lo) / ((hi - lo) / 12))) AS BIGINT) AS bin, COUNT(*) AS n FROM edges, r GROUP BY 1""")
def weight_histogram(spark, sf):
    return diagnostics.histogram(d.edges(spark, sf), "weight", 12)


@query("SELECT family, quantile_cont(weight, 0.5) AS median, quantile_cont(weight, 0.75) - quantile_cont(weight, 0.25) AS iqr FROM c_base GROUP BY 1")
def median_iqr(spark, sf):
    return diagnostics.median_iqr(d.raw(spark, sf), "weight", "family")


# orders by kernels; streams


def _instances(spark, sf):
    kept = d.classified(spark, sf).filter("kind <> 'tree_edge'")
    shares = kept.withColumn("instance_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return evidence.threshold(shares, F.col("instance_id") / 10, "instance_id")


@query()
def heuristic_orders(spark, sf):
    from .plans import orders

    return orders.heuristics(_instances(spark, sf), d.nodes(spark))


@query()
def mixing_order_by_levels(spark, sf):
    """The merged order of the tree of suppliers under the evidence of line items, one task a node of a level."""
    from .plans import fold

    tree = d.grown_tree(spark, sf)
    n = tree.count()
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select((1 + F.col("l_suppkey") % n).alias("donor"), (1 + F.col("l_partkey") % n).alias("receptor"), F.col("l_quantity").cast("long").alias("weight"))
    return fold.folded(li, tree)


@query()
def local_search_best(spark, sf):
    from .plans import orders

    return orders.searched(_instances(spark, sf), d.nodes(spark), [1, 2], 2000).filter("rank = 0")


@query()
def mh_chain(spark, sf):
    from .plans import orders

    return orders.chains(_instances(spark, sf), d.nodes(spark), [1, 2], 1000)


@query("""SELECT date_trunc('day', ts) AS start, CAST(1 + user_id % 63 AS BIGINT) AS donor, CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 63 AS BIGINT) AS receptor, COUNT(*) AS weight
  FROM events GROUP BY 1, 2, 3""", "")
def windowed_edge_weights(spark, sf):
    from .streaming import edges

    out = edges.windowed_weights(edges.events_as_evidence(spark.read.parquet(f"{sf}/events.parquet")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT a.label AS donor, b.label AS receptor FROM h a, h b WHERE NOT a.is_leaf AND NOT b.is_leaf AND a.label <> b.label
  AND NOT EXISTS (SELECT 1 FROM closure WHERE anc = a.label AND des = b.label) AND NOT EXISTS (SELECT 1 FROM closure WHERE anc = b.label AND des = a.label)""", d.GROWN)
def incomparable_pairs(spark, sf):
    from .sources import synthetic

    return synthetic.incomparable_pairs(d.grown_tree(spark, sf))


@query("""SELECT c.label, p.label AS parent FROM h c LEFT JOIN h p ON p.label = c.parent""", d.GROWN)
def parent_map(spark, sf):
    nodes = d.grown(spark, sf)
    up = nodes.select(F.col("label").alias("p"))
    return nodes.join(up, F.col("parent") == F.col("p"), "left").select("label", F.col("p").alias("parent"))


@query("""SELECT CASE WHEN line LIKE '%<recPhylo%' THEN 'eccetera' WHEN line LIKE '%T@%' AND line LIKE '%reconciled%' THEN 'ale'
    WHEN line LIKE '%Recipient%' AND line LIKE '%-->%' THEN CASE WHEN line LIKE '%Replacing Transfer%' THEN 'artra' ELSE 'ranger' END END AS tool, COUNT(*) AS n
  FROM (SELECT CASE l_linenumber WHEN 1 THEN '<recPhylo>' WHEN 2 THEN '1 reconciled T@1->2' WHEN 3 THEN 'Replacing Transfer, Mapping --> 1, Recipient --> 2'
    WHEN 4 THEN 'Transfer, Mapping --> 1, Recipient --> 2' ELSE 'A B 1' END AS line FROM lineitem) GROUP BY 1""", "")
def detect_format(spark, sf):
    """The marks of formats in lines, by the same rules as files."""
    from .sources.reports import detect_column

    n = F.col("l_linenumber")
    line = F.when(n == 1, "<recPhylo>").when(n == 2, "1 reconciled T@1->2").when(n == 3, "Replacing Transfer, Mapping --> 1, Recipient --> 2").when(n == 4, "Transfer, Mapping --> 1, Recipient --> 2").otherwise("A B 1")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(detect_column(line).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@query("""SELECT MAX(declared) AS declared, COUNT(*) FILTER (row = 'transfer') AS transfers FROM (
  SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey % 50 END AS declared, CASE WHEN l_linenumber > 1 THEN 'transfer' END AS row FROM lineitem)""", "")
def declared_support(spark, sf):
    """Declared sample counts and transfers of generated report lines, by built-in functions."""
    from .sources.reports import line_columns

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Total number of optimal solutions: "), (F.col("l_orderkey") % 50).cast("string"))).otherwise("m = LCA[a, b]: Transfer, Mapping --> 1, Recipient --> 2")
    got = line_columns(li.select(text.alias("value")))
    return got.agg(F.max("declared").alias("declared"), F.count_if(F.col("donor").isNotNull() & F.col("receptor").isNotNull()).alias("transfers"))
