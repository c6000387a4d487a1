"""Evidence, trees and orders derived in closed form from the star-schema tables, so that SQL can state the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evidence, scoring, trees


def nodes(spark: SparkSession) -> DataFrame:
    """The tree that evidence of line items speaks of: 63 nodes."""
    return trees.heap_tree(spark, 63)


def tree(spark: SparkSession) -> DataFrame:
    return trees.numbered(nodes(spark))


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a node for each supplier (all but the last if their number is even), lengths by nation."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((1 + F.col("s_suppkey")).cast("long").alias("k"), (1 + F.col("s_nationkey") % 3).cast("long").alias("length"))
    n = s.count()
    n -= 1 - n % 2
    return trees.heap_nodes(s.filter(F.col("k") <= n), n)


def grown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.numbered(grown(spark, sf_dir))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that is one long path with a leaf at each node: internal nodes 1, 3, 5, ..., leaves 2, 4, ... and the last, which is
    odd; a node a customer (all but the last if their number is even), as deep as half of them."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((1 + F.col("c_custkey")).cast("long").alias("label"), (1 + F.col("c_nationkey") % 3).cast("long").alias("length"))
    n = c.count()
    n -= 1 - n % 2
    k = F.col("label")
    parent = F.when(k == 1, F.lit(None)).when(k % 2 == 0, k - 1).otherwise(k - 2).cast("long")
    return c.filter(k <= n).select("label", parent.alias("parent"), ((k % 2 == 0) | (k == n)).alias("is_leaf"), "length")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of evidence a line item; distance is unknown on each order's first line, else the edges between."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = (1 + F.col("l_suppkey") % 63).cast("long"), (1 + F.col("l_partkey") % 63).cast("long")
    rows = li.select(a.alias("donor"), b.alias("receptor"), F.col("l_quantity").cast("long").alias("weight"), (F.col("l_orderkey") % 40).cast("long").alias("family"), F.col("l_linenumber").cast("long").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ingest_seq"))
    return rows.withColumn("distance", F.when(F.col("sample") > 1, heap_hops("donor", "receptor")))


def heap_hops(a: str, b: str):
    """Edges between two nodes of a heap tree: the ids are cut to one depth and compared by their common prefix."""
    da, db = F.length(F.bin(a)), F.length(F.bin(b))
    low = F.least(da, db)
    cut = lambda c, d: F.expr(f"shiftright({c}, cast({d} as int))")
    x = cut(a, f"length(bin({a})) - least(length(bin({a})), length(bin({b})))")
    y = cut(b, f"length(bin({b})) - least(length(bin({a})), length(bin({b})))")
    diff = x.bitwiseXOR(y)
    common = low - F.when(diff == 0, 0).otherwise(F.length(F.bin(diff)))
    return (da + db - 2 * common).cast("long")


def supplier_links(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    """(donor, receptor): an edge from each supplier's node to one further on, by `gap` and its nation."""
    nodes = grown(spark, sf_dir).filter("NOT is_leaf").select("label")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((1 + F.col("s_suppkey")).cast("long").alias("donor"), (1 + F.col("s_suppkey") + gap + F.col("s_nationkey")).cast("long").alias("receptor"))
    return s.join(nodes.withColumnRenamed("label", "donor"), "donor", "left_semi").join(nodes.withColumnRenamed("label", "receptor"), "receptor", "left_semi")


def small_instances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tree of six internal nodes for each supplier, and evidence on it from the supplier's line items."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("instance_id"))
    shape = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")))
    inner = s.withColumn("label", shape).withColumn("parent", F.when(F.col("label") > 1, F.shiftright("label", 1)))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    given = li.select(F.col("l_suppkey").cast("long").alias("instance_id"), (1 + F.col("l_partkey") % 6).cast("long").alias("donor"), (1 + F.col("l_orderkey") % 6).cast("long").alias("receptor"), F.col("l_quantity").cast("long").alias("weight"))
    return inner, given.groupBy("instance_id", "donor", "receptor").agg(F.sum("weight").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.edge_weights(raw(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.classify(edges(spark, sf_dir), tree(spark))


def input_positions(spark: SparkSession, of: DataFrame | None = None) -> DataFrame:
    return trees.input_order(tree(spark) if of is None else of).withColumn("order_id", F.lit(0).cast("long")).select("order_id", "label", "pos")


def hash_positions(spark: SparkSession, n: int = 20, of: DataFrame | None = None) -> DataFrame:
    return scoring.hash_orders(spark.range(n).select(F.col("id").alias("order_id")), tree(spark) if of is None else of)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a chain of states with integral energies."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select((F.col("event_id") % 4).alias("chain_id"), F.col("event_id").alias("step"), F.col("event_type").alias("state"), F.round(F.col("value") * 100).cast("long").alias("energy"))


#: The same relations in DuckDB SQL.
SQL = """
WITH h AS (
  SELECT k AS label, CASE WHEN k > 1 THEN k >> 1 END AS parent, k >= 32 AS is_leaf, CAST(1 + k % 3 AS BIGINT) AS length,
    CAST(length(bin(k)) - 1 AS BIGINT) AS depth, CAST((k << (6 - length(bin(k)))) * 64 + length(bin(k)) AS BIGINT) AS preorder
  FROM (SELECT unnest(range(1, 64)) AS k)
), closure AS (
  SELECT a.label AS anc, b.label AS des, b.depth - a.depth AS hops
  FROM h a JOIN h b ON b.depth >= a.depth AND (b.label >> (b.depth - a.depth)) = a.label
), c_base AS (
  SELECT CAST(1 + l_suppkey % 63 AS BIGINT) AS donor, CAST(1 + l_partkey % 63 AS BIGINT) AS receptor,
    CAST(l_quantity AS BIGINT) AS weight, CAST(l_orderkey % 40 AS BIGINT) AS family,
    CAST(l_linenumber AS BIGINT) AS sample, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ingest_seq
  FROM lineitem
), lca AS (
  SELECT a.des AS a, b.des AS b, arg_max(a.anc, h.depth) AS lca
  FROM closure a JOIN closure b ON a.anc = b.anc JOIN h ON h.label = a.anc GROUP BY 1, 2
), hops AS (
  SELECT l.a, l.b, l.lca, CAST(x.depth + y.depth - 2 * z.depth AS BIGINT) AS hops
  FROM lca l JOIN h x ON x.label = l.a JOIN h y ON y.label = l.b JOIN h z ON z.label = l.lca
), c_raw AS (
  SELECT c.*, CASE WHEN sample > 1 THEN hops END AS distance FROM c_base c JOIN hops ON a = donor AND b = receptor
), edges AS (
  SELECT donor, receptor, CAST(SUM(weight) AS BIGINT) AS weight, MIN(ingest_seq) AS first_seq FROM c_base GROUP BY 1, 2
), classified AS (
  SELECT e.*, CASE
      WHEN r.parent = e.donor AND NOT r.is_leaf THEN 'tree_edge'
      WHEN e.donor = e.receptor THEN 'itself'
      WHEN down.anc IS NOT NULL THEN 'desc'
      WHEN r.is_leaf THEN 'to_leaf' WHEN d.is_leaf THEN 'from_leaf'
      WHEN up.anc IS NOT NULL THEN 'anc' ELSE 'info' END AS kind
  FROM edges e JOIN h d ON d.label = e.donor JOIN h r ON r.label = e.receptor
  LEFT JOIN closure down ON down.anc = e.donor AND down.des = e.receptor
  LEFT JOIN closure up ON up.anc = e.receptor AND up.des = e.donor
), rootdist AS (
  SELECT des AS label, CAST(SUM(CASE WHEN h.parent IS NULL THEN 0 ELSE h.length END) AS BIGINT) AS dist
  FROM closure JOIN h ON h.label = anc GROUP BY 1
), input_pos AS (
  SELECT CAST(0 AS BIGINT) AS order_id, label, CAST(row_number() OVER (ORDER BY dist, preorder) - 1 AS BIGINT) AS pos
  FROM rootdist JOIN h USING (label) WHERE NOT is_leaf
), tosses AS (
  SELECT o AS order_id, label AS anc, 1 + ('0x' || substr(md5(o || ':' || label), 1, 8))::BIGINT AS toss
  FROM (SELECT unnest(range(0, 20)) AS o), h WHERE NOT is_leaf
), hash_pos AS (
  SELECT order_id, label, CAST(row_number() OVER (PARTITION BY order_id ORDER BY k, label) - 1 AS BIGINT) AS pos
  FROM (SELECT t.order_id, c.des AS label, SUM(t.toss) AS k FROM tosses t JOIN closure c ON c.anc = t.anc
        JOIN h ON h.label = c.des AND NOT h.is_leaf GROUP BY 1, 2)
), chain AS (
  SELECT event_id % 4 AS chain_id, event_id AS step, event_type AS state, CAST(ROUND(value * 100) AS BIGINT) AS energy FROM events
)
"""

#: The same views over the tree of suppliers.
GROWN = """
WITH few AS (SELECT COUNT(*) - 1 + COUNT(*) % 2 AS n FROM supplier), h AS (
  SELECT k AS label, CASE WHEN k > 1 THEN k >> 1 END AS parent, k > n // 2 AS is_leaf, CAST(1 + s_nationkey % 3 AS BIGINT) AS length,
    CAST(length(bin(k)) - 1 AS BIGINT) AS depth, CAST((k << (length(bin(n)) - length(bin(k)))) * 64 + length(bin(k)) AS BIGINT) AS preorder
  FROM (SELECT CAST(s_suppkey + 1 AS BIGINT) AS k, s_nationkey FROM supplier), few WHERE k <= n
), closure AS""" + SQL.split("), closure AS", 1)[1]
