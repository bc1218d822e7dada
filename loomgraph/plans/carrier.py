"""A code graph over relational tables: regions are modules, nations files, suppliers and customers classes, orders and parts functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.graph import CodeGraph
from loomgraph.sources.shared import table

_VERTICES = (("region", "r_regionkey", "MODULE", "r_name"), ("nation", "n_nationkey", "FILE", "n_name"), ("supplier", "s_suppkey", "CLASS", "s_name"), ("customer", "c_custkey", "CLASS", "c_name"), ("orders", "o_orderkey", "FUNCTION", None), ("part", "p_partkey", "FUNCTION", "p_name"))


def key(kind: str, col: str):
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, ident, kind, label in _VERTICES:
        prefix = "order" if name == "orders" else name
        k = key(prefix, ident)
        df = table(spark, sf_dir, name).select(k.alias("stable_key"), F.lit(kind).alias("kind"), (F.col(label) if label else k).alias("name"))
        out = df if out is None else out.unionByName(df)
    return out


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: each customer nation's two other supplier nations of the largest sales."""
    t = lambda n: table(spark, sf_dir, n)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    supplier = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("t"))
    sold = t("lineitem").select("l_orderkey", "l_suppkey", cents.alias("v")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "t").agg(F.sum("v").alias("v"))
    buyer = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("s")), F.col("o_custkey") == F.col("c_custkey"))
    total = sold.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).where("s <> t").groupBy("s", "t").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("s").orderBy(F.desc("v"), "t")
    return total.withColumn("r", F.row_number().over(w)).where("r <= 2").select(key("nation", "s").alias("source"), key("nation", "t").alias("target"))


def edges(spark: SparkSession, sf_dir: str, types: tuple = ("CONTAINS", "CALLS", "REFERENCES", "IMPORTS", "DEPENDS_ON")) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = []

    def add(df, kind, source, target, occurrence=None, confidence=None, line=None):
        o = occurrence if occurrence is not None else F.lit("")
        c = confidence if confidence is not None else F.lit(1.0)
        e = df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), o.alias("occurrence"), c.cast("double").alias("confidence"), (line if line is not None else F.lit(None)).cast("int").alias("start_line"))
        parts.append(e.withColumn("edge_key", F.sha2(F.concat_ws("|", "edge_type", "source", "target", "occurrence"), 256)).drop("occurrence"))

    if "CONTAINS" in types:
        add(t("nation"), "CONTAINS", key("region", "n_regionkey"), key("nation", "n_nationkey"))
        add(t("supplier"), "CONTAINS", key("nation", "s_nationkey"), key("supplier", "s_suppkey"))
        add(t("customer"), "CONTAINS", key("nation", "c_nationkey"), key("customer", "c_custkey"))
        add(t("orders"), "CONTAINS", key("customer", "o_custkey"), key("order", "o_orderkey"))
    for kind, ident, prefix in (("CALLS", "l_partkey", "part"), ("REFERENCES", "l_suppkey", "supplier")):
        if kind in types:
            occurrence = F.concat_ws("|", *[c.cast("string") for c in (F.col("l_linenumber"), F.round("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)"), F.col("l_partkey"), F.col("l_suppkey"))])
            add(t("lineitem"), kind, key("order", "l_orderkey"), key(prefix, ident), occurrence, F.round(1 - F.col("l_discount"), 4), F.col("l_linenumber"))
    if "IMPORTS" in types:
        add(imports(spark, sf_dir), "IMPORTS", F.col("source"), F.col("target"))
    if "DEPENDS_ON" in types:
        owner = t("nation").select(key("nation", "n_nationkey").alias("n"), key("region", "n_regionkey").alias("r"))
        i = imports(spark, sf_dir).join(owner.select(F.col("n").alias("source"), F.col("r").alias("sr")), "source").join(owner.select(F.col("n").alias("target"), F.col("r").alias("tr")), "target")
        add(i.where("sr <> tr").select("sr", "tr").distinct(), "DEPENDS_ON", F.col("sr"), F.col("tr"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph(spark: SparkSession, sf_dir: str, types: tuple = ("CONTAINS", "CALLS", "REFERENCES", "IMPORTS", "DEPENDS_ON")) -> CodeGraph:
    return CodeGraph(entities(spark, sf_dir), edges(spark, sf_dir, types))


#: The same graph in SQL, as the head of a WITH.
SQL = """
ent AS (
  SELECT 'region:' || r_regionkey AS stable_key, 'MODULE' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'FILE', n_name FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'CLASS', s_name FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'CLASS', c_name FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'FUNCTION', 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'FUNCTION', p_name FROM part),
sold AS (
  SELECT c_nationkey AS s, s_nationkey AS t, sum(round(l_extendedprice * 100)::BIGINT) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
imp AS (
  SELECT 'nation:' || s AS source, 'nation:' || t AS target, s, t
  FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, t) AS r FROM sold) WHERE r <= 2),
raw AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'CONTAINS' AS edge_type, '' AS occurrence, 1.0::DOUBLE AS confidence, NULL::INTEGER AS start_line FROM nation
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS', '', 1.0, NULL FROM supplier
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', '', 1.0, NULL FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CONTAINS', '', 1.0, NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CALLS', occ, conf, l_linenumber FROM li
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'REFERENCES', occ, conf, l_linenumber FROM li
  UNION ALL SELECT source, target, 'IMPORTS', '', 1.0, NULL FROM imp
  UNION ALL SELECT DISTINCT 'region:' || a.n_regionkey, 'region:' || b.n_regionkey, 'DEPENDS_ON', '', 1.0, NULL
    FROM imp JOIN nation a ON imp.s = a.n_nationkey JOIN nation b ON imp.t = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey),
edge AS (SELECT source, target, edge_type, confidence, start_line, sha256(edge_type || '|' || source || '|' || target || '|' || occurrence) AS edge_key FROM raw)
"""
_LI = "li AS (SELECT *, l_linenumber || '|' || round(l_quantity)::BIGINT || '|' || round(l_extendedprice * 100)::BIGINT || '|' || floor(epoch(l_shipdate))::BIGINT || '|' || l_partkey || '|' || l_suppkey AS occ, round(1 - l_discount, 4)::DOUBLE AS conf FROM lineitem),"


def sql(body: str, recursive: bool = False) -> str:
    """``body`` after the graph's common tables; it begins with SELECT, or with a comma and more tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{_LI}{SQL}{body}"
