"""Registered queries: each operator over given tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import values as fv
from loomgraph.operators import compare, lifecycle, resolve, retrieval, validate
from loomgraph.operators.graph import CodeGraph, cycle_edges, transitive, traverse
from loomgraph.sources import graph_json
from loomgraph.sources.artifacts import artifacts, classified
from loomgraph.sources.shared import table

from . import carrier

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def start(spark, *keys: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "start string")


# summaries


@query(carrier.sql("SELECT kind, count(*) AS n FROM ent GROUP BY kind"))
def entities_by_kind(spark, d):
    return carrier.entities(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(carrier.sql("SELECT edge_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM edge GROUP BY edge_type"))
def edges_by_type(spark, d):
    return carrier.edges(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


_DEGREE = """, sides AS (SELECT source AS k, target AS other, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, source, 0, 1 FROM edge),
deg AS (SELECT stable_key, kind, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree, count(DISTINCT other) AS unique_neighbors,
        (coalesce(sum(i), 0) + coalesce(sum(o), 0))::BIGINT AS degree FROM ent LEFT JOIN sides ON stable_key = k GROUP BY stable_key, kind)
SELECT * FROM deg"""


@query(carrier.sql(_DEGREE))
def entity_degree(spark, d):
    return carrier.graph(spark, d).degrees()


@query(carrier.sql(_DEGREE + " ORDER BY degree DESC, unique_neighbors DESC, stable_key LIMIT 10"))
def top_connected_entities(spark, d):
    return carrier.graph(spark, d).top_connected(10)


@query(carrier.sql("SELECT kind, count(*) AS n FROM ent WHERE stable_key NOT IN (SELECT source FROM edge WHERE edge_type = 'CALLS' UNION SELECT target FROM edge WHERE edge_type = 'CALLS') GROUP BY kind"))
def isolated_entities(spark, d):
    return carrier.graph(spark, d, ("CALLS",)).isolated().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT r_regionkey, 'region:' || r_regionkey AS k FROM region
 UNION ALL SELECT n_regionkey, 'nation:' || n_nationkey FROM nation
 UNION ALL SELECT n_regionkey, 'supplier:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT min(k) AS component, count(*) AS size FROM m GROUP BY r_regionkey""")
def containment_components(spark, d):
    ents = carrier.entities(spark, d).where("NOT startswith(stable_key, 'part:')")
    found = CodeGraph(ents, carrier.edges(spark, d, ("CONTAINS",))).component_of()
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(carrier.sql("SELECT (SELECT count(*) FROM ent) AS n_entities, count(*) AS n_edges, count(*) FILTER (edge_type = 'CALLS') AS n_calls, count(*) FILTER (edge_type = 'IMPORTS') AS n_imports FROM edge"))
def graph_summary_totals(spark, d):
    e = carrier.edges(spark, d).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("edge_type") == "CALLS").alias("n_calls"), F.count_if(F.col("edge_type") == "IMPORTS").alias("n_imports"))
    return carrier.entities(spark, d).agg(F.count(F.lit(1)).alias("n_entities")).join(e)


# adjacency

_EDGE = "edge_key, source, target, edge_type"


@query(carrier.sql(f"SELECT {_EDGE} FROM edge WHERE source = 'nation:3'"))
def outgoing_edges(spark, d):
    return carrier.graph(spark, d).outgoing("nation:3").select(*_EDGE.split(", "))


@query(carrier.sql(f"SELECT {_EDGE} FROM edge WHERE target = 'nation:3'"))
def incoming_edges(spark, d):
    return carrier.graph(spark, d).incoming("nation:3").select(*_EDGE.split(", "))


@query(carrier.sql(f"SELECT {_EDGE} FROM edge WHERE source = 'nation:3' AND edge_type = 'IMPORTS'"))
def outgoing_by_type(spark, d):
    return carrier.graph(spark, d).outgoing("nation:3", "IMPORTS").select(*_EDGE.split(", "))


@query(carrier.sql(f"SELECT {_EDGE} FROM edge WHERE target = 'supplier:7' AND edge_type = 'REFERENCES'"))
def incoming_by_type(spark, d):
    return carrier.graph(spark, d).incoming("supplier:7", "REFERENCES").select(*_EDGE.split(", "))


@query(carrier.sql("SELECT neighbor, count(*) AS edges FROM (SELECT target AS neighbor FROM edge WHERE source = 'supplier:7' UNION ALL SELECT source FROM edge WHERE target = 'supplier:7') GROUP BY neighbor"))
def neighborhood_one_hop(spark, d):
    return carrier.graph(spark, d).neighborhood("supplier:7")


@query(carrier.sql("SELECT * FROM ent WHERE stable_key = 'customer:5'"))
def point_lookup(spark, d):
    return carrier.graph(spark, d).entity("customer:5")


def _walks(here, there, types, depth, first):
    return carrier.sql(f""", walk AS (SELECT s AS start, s AS node, 0 AS depth, '' AS path FROM (VALUES {first}) v(s)
 UNION ALL SELECT w.start, e.{there}, w.depth + 1, w.path || '>' || e.edge_key FROM walk w JOIN edge e ON e.{here} = w.node WHERE e.edge_type IN ({types}) AND w.depth < {depth}),
best AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY depth, path) AS r FROM walk)
SELECT start, node AS entity, depth, substr(path, 2) AS path FROM best WHERE r = 1 AND depth > 0""", True)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("start", "entity", "depth", F.concat_ws(">", "path").alias("path"))


@query(_walks("source", "target", "'IMPORTS'", 3, "('nation:0'), ('nation:9')"))
def forward_traversal_imports(spark, d):
    return _shown(carrier.graph(spark, d, ("IMPORTS",)).forward(start(spark, "nation:0", "nation:9"), 3, "IMPORTS"))


@query(_walks("target", "source", "'IMPORTS'", 3, "('nation:3'), ('nation:9'), ('nation:23')"))
def reverse_traversal_imports(spark, d):
    return _shown(carrier.graph(spark, d, ("IMPORTS",)).reverse(start(spark, "nation:3", "nation:9", "nation:23"), 3, "IMPORTS"))


@query(_walks("target", "source", "'CALLS', 'CONTAINS'", 3, "('part:1'), ('part:2')"))
def reverse_impact_paths(spark, d):
    return _shown(carrier.graph(spark, d, ("CALLS", "CONTAINS")).reverse(start(spark, "part:1", "part:2"), 3))


#: How much of an impact an edge passes on.
WEIGHTS = {"CALLS": 1.0, "IMPLEMENTS": 0.95, "REFERENCES": 0.9, "ROUTES_TO": 0.9, "IMPORTS": 0.7, "POSSIBLE_CALL": 0.4}


@query(carrier.sql(""", walk AS (SELECT s AS start, s AS node, 0 AS depth, 1.0::DOUBLE AS w FROM (VALUES ('nation:3'), ('nation:9'), ('nation:23')) v(s)
 UNION ALL SELECT start, e.source, depth + 1, w * 0.7 FROM walk JOIN edge e ON e.target = walk.node WHERE e.edge_type = 'IMPORTS' AND depth < 3)
SELECT start, node AS entity, min(depth) AS depth, round(max(w), 6) AS impact FROM walk WHERE node <> start GROUP BY start, node""", True))
def weighted_impact_ranking(spark, d):
    g = carrier.graph(spark, d, ("IMPORTS",))
    reached = traverse(g, start(spark, "nation:3", "nation:9", "nation:23"), 3, ("IMPORTS",), True)
    weight = g.edges.select("edge_key", F.coalesce(*[F.when(F.col("edge_type") == k, v) for k, v in WEIGHTS.items()], F.lit(0.0)).alias("w"))
    steps = reached.select("start", "entity", "depth", F.explode("path").alias("edge_key")).join(weight, "edge_key")
    return steps.groupBy("start", "entity", "depth").agg(F.round(F.exp(F.sum(F.log("w"))), 6).alias("impact"))


@query(carrier.sql(""", walk AS (SELECT 'nation:0' AS node, 0 AS depth UNION ALL SELECT e.source, depth + 1 FROM walk JOIN edge e ON e.target = walk.node WHERE e.edge_type = 'IMPORTS' AND depth < 2),
hit AS (SELECT DISTINCT node FROM walk), n AS (SELECT count(*) AS n_files FROM ent WHERE kind = 'FILE')
SELECT (SELECT count(*) FROM hit) AS n_invalid, n_files, CASE WHEN (SELECT count(*) FROM hit) <= least(500, floor(n_files * 0.2)) THEN 'PARTIAL' ELSE 'FULL' END AS plan FROM n""", True))
def bounded_invalidation(spark, d):
    g = carrier.graph(spark, d, ("IMPORTS",))
    changed = start(spark, "nation:0")
    hit = g.reverse(changed, 2, "IMPORTS").select("entity").union(changed).distinct().agg(F.count(F.lit(1)).alias("n_invalid"))
    n = g.entities.where("kind = 'FILE'").agg(F.count(F.lit(1)).alias("n_files"))
    return hit.join(n).withColumn("plan", F.when(F.col("n_invalid") <= F.least(F.lit(500), F.floor(F.col("n_files") * 0.2)), "PARTIAL").otherwise("FULL"))


# constraints


@query(carrier.sql(""", e AS (SELECT DISTINCT source, target FROM edge WHERE edge_type = 'IMPORTS'),
fwd AS (SELECT source AS a, target AS b FROM e UNION SELECT f.a, e.target FROM fwd f JOIN e ON f.b = e.source),
cyc AS (SELECT DISTINCT a FROM fwd WHERE a = b)
SELECT DISTINCT e.source, e.target FROM e
WHERE (e.source IN (SELECT a FROM cyc) OR e.source IN (SELECT b FROM fwd WHERE a IN (SELECT a FROM cyc)))
  AND (e.target IN (SELECT a FROM cyc) OR e.target IN (SELECT a FROM fwd WHERE b IN (SELECT a FROM cyc)))""", True))
def containment_cycle_edges(spark, d):
    return cycle_edges(carrier.edges(spark, d, ("IMPORTS",)))


@query(carrier.sql("""SELECT edge_key, target AS source, source AS target, edge_type FROM edge WHERE edge_type IN ('CONTAINS', 'REFERENCES', 'IMPORTS')
 AND (edge_type = 'CONTAINS' AND (split_part(target, ':', 1) = 'order' OR split_part(source, ':', 1) NOT IN ('region', 'nation', 'customer'))
      OR edge_type = 'REFERENCES' AND FALSE)"""))
def domain_violations(spark, d):
    g = carrier.graph(spark, d, ("CONTAINS", "REFERENCES", "IMPORTS"))
    swapped = g.edges.select("edge_key", F.col("target").alias("source"), F.col("source").alias("target"), "edge_type")
    return validate.domain_violations(CodeGraph(g.entities, swapped)).select("edge_key", "source", "target", "edge_type")


@query(carrier.sql("""SELECT edge_key, side, endpoint FROM (SELECT edge_key, 'source' AS side, source AS endpoint FROM edge UNION ALL SELECT edge_key, 'target', target FROM edge)
 WHERE endpoint LIKE 'supplier:%' AND split_part(endpoint, ':', 2)::BIGINT % 10 = 3"""))
def missing_endpoints(spark, d):
    g = carrier.graph(spark, d)
    gone = F.col("stable_key").startswith("supplier:") & (F.split("stable_key", ":")[1].cast("long") % 10 == 3)
    return validate.missing_endpoints(CodeGraph(g.entities.where(~gone), g.edges))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey)) AS n_values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def duplicate_conflicts(spark, d):
    return validate.duplicate_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(carrier.sql("SELECT edge_key, source, target FROM edge WHERE edge_type = 'CALLS' AND start_line = 1"))
def call_reference_overlap(spark, d):
    calls = carrier.edges(spark, d, ("CALLS",))
    again = calls.where("start_line = 1").withColumn("edge_type", F.lit("REFERENCES"))
    return validate.occurrence_overlaps(calls.unionByName(again), ["start_line"]).select("edge_key", "source", "target")


# identities and values


@query(carrier.sql("SELECT edge_key, edge_type, source, target FROM edge WHERE edge_type IN ('IMPORTS', 'DEPENDS_ON', 'CALLS')"))
def edge_keys(spark, d):
    return carrier.edges(spark, d, ("IMPORTS", "DEPENDS_ON", "CALLS")).select("edge_key", "edge_type", "source", "target")


@query("""SELECT 'n/' || n_nationkey AS path, 'sk:v1:sha256:' || sha256('["loom-entity-v1","n/' || n_nationkey || '","FILE","' || n_name || '"]') AS stable_key FROM nation""")
def stable_keys(spark, d):
    path = F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select(path.alias("path"), fv.named_identity(path, F.lit("FILE"), F.col("n_name")).alias("stable_key"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '@' || lower(p_brand) || '/x/y' WHEN 1 THEN 'fs/promises' WHEN 2 THEN './' || p_partkey
 WHEN 3 THEN 'https://h/' || p_partkey WHEN 4 THEN 'pkg' || p_partkey || '/sub' ELSE 'node:test' END AS spec FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN regexp_extract(spec, '^@[^/]*/[^/]*') WHEN 1 THEN 'node:fs' WHEN 4 THEN 'pkg' || p_partkey WHEN 5 THEN 'node:test' END AS package FROM s""")
def external_package_normalization(spark, d):
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    spec = F.when(m == 0, F.concat(F.lit("@"), F.lower("p_brand"), F.lit("/x/y"))).when(m == 1, "fs/promises").when(m == 2, F.concat(F.lit("./"), k)).when(m == 3, F.concat(F.lit("https://h/"), k)).when(m == 4, F.concat(F.lit("pkg"), k, F.lit("/sub"))).otherwise("node:test")
    return table(spark, d, "part").select("p_partkey", fv.external_package(spec).alias("package"))


_HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"


@query(f"WITH h AS ({_HREFS}) SELECT page_id, href, CASE WHEN href LIKE '/%' THEN 'ABSOLUTE' END AS problem, nullif(regexp_replace(href, '^/', ''), '') AS path FROM h")
def path_normalization(spark, d):
    h = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.select("page_id", "href", fv.path_problem(F.col("href")).alias("problem"), fv.normalized_path(F.regexp_replace("href", "^/", "")).alias("path"))


@query("SELECT doc_id, sha256(text) AS hash, 'source/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS object_key, strlen(text)::BIGINT AS n_bytes, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\\r?\\n')) END AS n_lines FROM documents")
def source_artifacts(spark, d):
    return artifacts(table(spark, d, "documents")).select("doc_id", "hash", "object_key", "n_bytes", "n_lines")


@query("SELECT sha256(text) AS hash, count(*) AS n_rows, min(doc_id) AS first_doc, min(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1")
def unique_blobs(spark, d):
    return artifacts(table(spark, d, "documents")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"), F.min("n_bytes").alias("n_bytes"))


@query("WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) SELECT CASE WHEN h IN (SELECT h FROM a) THEN 'REUSED' ELSE 'UPLOADED' END AS status, count(*) AS n FROM b GROUP BY 1")
def blob_put_tally(spark, d):
    a = artifacts(table(spark, d, "documents"))
    return lifecycle.blob_tally(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"))


@query("SELECT DISTINCT 'source/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS object_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def orphan_blobs(spark, d):
    a = artifacts(table(spark, d, "documents")).select("doc_id", "object_key")
    used = a.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return lifecycle.orphans(a.select("object_key").distinct(), used)


@query("""WITH l AS (SELECT sha256(doc_id || '|' || sha256(text)) AS leaf FROM documents), b AS (SELECT substr(leaf, 1, 3) AS bucket, sha256(string_agg(leaf, '' ORDER BY leaf)) AS digest, count(*) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(digest, '' ORDER BY bucket)) AS revision, sum(n)::BIGINT AS n_artifacts FROM b""")
def content_revision(spark, d):
    a = artifacts(table(spark, d, "documents"))
    return lifecycle.content_revision(a.select(F.col("doc_id").cast("string").alias("path"), "hash"))


# windows and lifecycle


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occurrence FROM conversations")
def anonymous_occurrence(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("occurrence"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events")
def ordinal_numbering(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("ordinal"))


def _snapshots(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("repository"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("ready_at"), "event_type", "value")


@query("""WITH s AS (SELECT user_id AS repository, event_id AS snapshot_id, ts AS ready_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events)
SELECT snapshot_id, repository, position FROM s WHERE position > 5 AND snapshot_id % 7 <> 0""")
def retention_ready(spark, d):
    s = _snapshots(spark, d).select("repository", "snapshot_id", "ready_at")
    pins = s.where("snapshot_id % 7 = 0").select("snapshot_id", (F.col("ready_at") + F.expr("INTERVAL 36500 DAYS")).alias("expires_at"))
    newest = s.groupBy("repository").agg(F.max(F.struct("ready_at", "snapshot_id")).alias("m")).select("m.snapshot_id")
    return lifecycle.retention(s, pins, newest, F.lit("2000-01-01").cast("timestamp")).select("snapshot_id", "repository", "position")


@query("SELECT event_id, user_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND event_type = (SELECT min(event_type) FROM events)")
def stale_building(spark, d):
    e = table(spark, d, "events")
    edge = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("edge"), F.min("event_type").alias("kind"))
    return e.join(F.broadcast(edge), (F.col("ts") < F.col("edge")) & (F.col("event_type") == F.col("kind"))).select("event_id", "user_id")


@query("SELECT user_id AS repository, event_id AS snapshot_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS current FROM events")
def snapshot_listing(spark, d):
    w = Window.partitionBy("repository").orderBy(F.desc("ready_at"), F.desc("snapshot_id"))
    return _snapshots(spark, d).select("repository", "snapshot_id", F.col("event_type").alias("status"), (F.row_number().over(w) == 1).alias("current"))


@query("SELECT o_orderkey, count(l_orderkey) AS counted, (o_orderkey % 8)::BIGINT AS declared, count(l_orderkey) = o_orderkey % 8 AS ok FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def count_reconciliation(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c"))
    j = table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    counted, declared = F.coalesce("c", F.lit(0)), F.col("o_orderkey") % 8
    return j.select("o_orderkey", counted.cast("long").alias("counted"), declared.alias("declared"), (counted == declared).alias("ok"))


@query("SELECT user_id AS snapshot_id, event_type AS owner, max(ts) AS written_at, max(ts) + INTERVAL 30 DAY AS expires_at FROM events GROUP BY 1, 2")
def pin_upsert(spark, d):
    p = table(spark, d, "events").select(F.col("user_id").alias("snapshot_id"), F.col("event_type").alias("owner"), F.col("ts").alias("written_at"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), "event_id")
    return lifecycle.pin_upsert(p.where("event_id % 2 = 0").drop("event_id"), p.where("event_id % 2 = 1").drop("event_id"))


# comparison

_METRICS = "round(CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"
_SETS = "e AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1), a AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE n_chars > 900)"


def _sets(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return j.where("quality = 1"), j.where("n_chars > 900")


@query(f"WITH {_SETS}, c AS (SELECT count(*) FILTER (e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS tp, count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (a.doc_id IS NULL) AS fn FROM e FULL JOIN a ON e.doc_id = a.doc_id) SELECT *, {_METRICS} FROM c")
def set_metrics(spark, d):
    return compare.metrics(compare.counts(*_sets(spark, d), ["doc_id"]))


@query(f"WITH {_SETS}, c AS (SELECT coalesce(e.lang, a.lang) AS lang, count(*) FILTER (e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS tp, count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (a.doc_id IS NULL) AS fn FROM e FULL JOIN a ON e.doc_id = a.doc_id GROUP BY 1) SELECT *, {_METRICS} FROM c UNION ALL SELECT 'micro', *, {_METRICS} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c)")
def micro_average(spark, d):
    c = compare.counts(*_sets(spark, d), ["doc_id"], ["lang"])
    total = c.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]).select(F.lit("micro").alias("lang"), "*")
    return compare.metrics(c.unionByName(total))


@query(carrier.sql("SELECT source, target, start_line, round(confidence, 4) AS confidence FROM edge e WHERE edge_type = 'CALLS' AND confidence >= (SELECT max(g.confidence) FROM edge g WHERE g.edge_type = 'CALLS' AND g.start_line = 2 AND g.target = e.target) UNION ALL SELECT source, target, start_line, round(confidence, 4) FROM edge e WHERE edge_type = 'CALLS' AND target NOT IN (SELECT target FROM edge WHERE edge_type = 'CALLS' AND start_line = 2)"))
def golden_min_confidence(spark, d):
    calls = carrier.edges(spark, d, ("CALLS",))
    return compare.above_golden(calls, calls.where("start_line = 2"), "target").select("source", "target", "start_line", F.round("confidence", 4).alias("confidence"))


@query("SELECT 'missing' AS side, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) UNION ALL SELECT 'unexpected', count(DISTINCT l_orderkey) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'common', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def set_differences(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    n = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(o.join(li, "o_orderkey", "left_anti"), "missing").union(n(li.join(o, "o_orderkey", "left_anti"), "unexpected")).union(n(o.join(li, "o_orderkey", "left_semi"), "common"))


@query("""WITH o AS (SELECT l_orderkey, l_partkey AS owner, l_linenumber - l_quantity::INT AS lo, l_linenumber + l_quantity::INT AS hi FROM lineitem),
i AS (SELECT DISTINCT l_orderkey, l_linenumber AS id, l_linenumber * 5 AS point FROM lineitem)
SELECT l_orderkey, id, min(struct_pack(w := hi - lo, o := owner)).o AS owner FROM i JOIN o USING (l_orderkey) WHERE lo <= point AND point <= hi GROUP BY 1, 2""")
def innermost_owner(spark, d):
    li = table(spark, d, "lineitem")
    q = F.round("l_quantity").cast("int")
    outer = li.select("l_orderkey", F.col("l_partkey").alias("owner"), (F.col("l_linenumber") - q).alias("lo"), (F.col("l_linenumber") + q).alias("hi"))
    inner = li.select("l_orderkey", F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 5).alias("point")).distinct()
    return lifecycle.innermost(inner, outer, ["l_orderkey"])


@query("""WITH m AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/') AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/[a-z]{2}/') FROM pages),
c AS (SELECT page_id, root, row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC) AS r FROM pages JOIN m ON root <> '' AND starts_with(url, root)) SELECT page_id, root AS module FROM c WHERE r = 1""")
def longest_prefix_module(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    depth1, depth2 = (F.regexp_extract("url", p, 0) for p in (r"^[a-z]+://[^/]+/", r"^[a-z]+://[^/]+/[a-z]{2}/"))
    modules = pages.select(F.explode(F.array(depth1, depth2)).alias("root")).where("root <> ''").distinct()
    # candidate prefixes of a page, longest first: an equi-join instead of a prefix comparison with every module
    cand = pages.select("page_id", F.posexplode(F.array(depth2, depth1)).alias("pos", "root"))
    return cand.join(modules, "root").groupBy("page_id").agg(F.min_by("root", "pos").alias("module"))


@query("""WITH e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation WHERE n_nationkey % 5 <> 0)
, c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT * FROM c""".replace("WITH e", "WITH RECURSIVE e"))
def alias_closure(spark, d):
    k = F.col("n_nationkey")
    return transitive(table(spark, d, "nation").where(k % 5 != 0).select(k.alias("a"), ((k * 3 + 1) % 25).alias("b")))


# analytics


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), n AS (SELECT f, count(*) AS n FROM f GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS support FROM f x JOIN f y ON x.c = y.c AND x.f < y.f GROUP BY 1, 2)
SELECT a, b, support, round(support / na.n, 6) AS a_to_b, round(support / nb.n, 6) AS b_to_a, round(support / (na.n + nb.n - support), 6) AS jaccard FROM p JOIN n na ON a = na.f JOIN n nb ON b = nb.f""")
def cochange_association(spark, d):
    out = compare.cochange(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")))
    return out.select("a", "b", "support", *[F.round(c, 6).alias(c) for c in ("a_to_b", "b_to_a", "jaccard")])


@query("SELECT c_nationkey, o_custkey, count(*) AS commits, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def contribution_share(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("commits"))
    j = n.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    # totals by an aggregate combined before its shuffle: a nation's customers don't meet in one task
    total = j.groupBy("c_nationkey").agg(F.sum("commits").alias("total"))
    return j.join(total, "c_nationkey").select("c_nationkey", "o_custkey", "commits", F.round(F.col("commits") / F.col("total"), 6).alias("share"))


_YEAR = "SELECT l_partkey, count(*) AS declaration, sum(round(l_quantity)::BIGINT)::BIGINT AS implementation FROM lineitem WHERE year(l_shipdate) = {} GROUP BY 1"


@query(f"""WITH y AS (SELECT min(year(l_shipdate)) + 1 AS y FROM lineitem), b AS ({_YEAR.format('(SELECT y FROM y)')}), a AS ({_YEAR.format('(SELECT y + 1 FROM y)')})
SELECT * FROM (SELECT coalesce(b.l_partkey, a.l_partkey) AS l_partkey, CASE WHEN b.l_partkey IS NULL THEN 'ADDED' WHEN a.l_partkey IS NULL THEN 'REMOVED'
 WHEN a.declaration <> b.declaration AND a.implementation <> b.implementation THEN 'BOTH' WHEN a.declaration <> b.declaration THEN 'DECLARATION' WHEN a.implementation <> b.implementation THEN 'IMPLEMENTATION' END AS change
 FROM b FULL JOIN a ON b.l_partkey = a.l_partkey) WHERE change IS NOT NULL""")
def snapshot_diff(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), F.round("l_quantity").cast("long").alias("q"))
    first = li.agg((F.min("y") + 1).alias("first"))
    by = li.join(F.broadcast(first), F.col("y").between(F.col("first"), F.col("first") + 1)).groupBy("l_partkey", (F.col("y") - F.col("first")).alias("side")).agg(F.count(F.lit(1)).alias("declaration"), F.sum("q").alias("implementation"))
    return compare.snapshot_diff(by.where("side = 0"), by.where("side = 1"), "l_partkey")


@query(carrier.sql(_DEGREE.replace("SELECT * FROM deg", "SELECT kind, CASE WHEN in_degree >= 100 THEN 'HIGH' WHEN in_degree >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM deg GROUP BY 1, 2")))
def risk_decision(spark, d):
    risk = F.when(F.col("in_degree") >= 100, "HIGH").when(F.col("in_degree") >= 10, "MEDIUM").otherwise("LOW")
    return carrier.graph(spark, d).degrees().groupBy("kind", risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


_TERMS = ("thtion", "der", "que")


def _hits(spark, d):
    words = F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")
    tf = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(words)).alias("term")).where(F.col("term").isin(*_TERMS))
    return tf.groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


_HITS = "SELECT doc_id, count(*)::DOUBLE AS score FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term IN ('thtion', 'der', 'que') GROUP BY 1"


@query(_HITS)
def lexical_search(spark, d):
    return _hits(spark, d)


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS sim FROM q JOIN embeddings ON vec_id <> q)
SELECT q, vec_id, round(sim, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def vector_search(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    return retrieval.nearest_vectors(e, q, 10).select("q", "vec_id", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH c AS (SELECT 'lexical' AS channel, doc_id AS item, score FROM ({_HITS}) UNION ALL SELECT 'length', doc_id, n_chars::DOUBLE FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, item) AS rank FROM c) SELECT item, round(sum(1 / (60 + rank)), 8) AS rrf FROM r GROUP BY item""")
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").select(F.lit("length").alias("channel"), F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("score"))
    c = _hits(spark, d).select(F.lit("lexical").alias("channel"), F.col("doc_id").alias("item"), "score").union(docs)
    return compare.reciprocal_rank_fusion(c).select("item", F.round("rrf", 8).alias("rrf"))


@query("""WITH r AS (SELECT lang, doc_id, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id))
SELECT lang, round(count(*) FILTER (rank <= 10 AND quality = 1) / least(10, count(*)), 6) AS precision_at_10, round(count(*) FILTER (rank <= 10 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall_at_10,
 round(coalesce(1 / min(rank) FILTER (quality = 1), 0), 6) AS mrr FROM r GROUP BY lang""")
def retrieval_metrics(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    r = compare.ranked(j, "lang", F.desc("n_chars"), F.col("doc_id"))
    good = F.col("quality") == 1
    hits, n, relevant, first = F.count_if((F.col("rank") <= 10) & good), F.count(F.lit(1)), F.count_if(good), F.min(F.when(good, F.col("rank")))
    return r.groupBy("lang").agg(F.round(hits / F.least(F.lit(10), n), 6).alias("precision_at_10"), F.round(hits / F.nullif(relevant, F.lit(0)), 6).alias("recall_at_10"), F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("mrr"))


# every row of the domain table


def _domain_sql() -> str:
    allowed = " OR ".join(f"edge_type = '{k}' AND s IN ({', '.join(map(repr, a))}) AND t IN ({', '.join(map(repr, b))})" for k, rules in validate.DOMAINS.items() for a, b in rules)
    return f"""WITH k AS (SELECT unnest({list(fv.ENTITY_KINDS)}) AS kind), y AS (SELECT unnest({list(fv.EDGE_TYPES)}) AS edge_type),
e AS (SELECT edge_type, a.kind AS s, b.kind AS t FROM y, k a, k b)
SELECT edge_type, count(*) AS n_refused FROM e WHERE NOT ({allowed}) GROUP BY edge_type"""


@query(_domain_sql())
def domain_matrix(spark, d):
    kinds = spark.createDataFrame([(k, k) for k in fv.ENTITY_KINDS], "stable_key string, kind string")
    # each kind once as a source and once as a target: no edge joins an entity to itself
    ents = kinds.union(kinds.select(F.concat(F.lit("t:"), "stable_key"), "kind"))
    rows = [(f"{y}|{a}|{b}", a, f"t:{b}", y) for y in fv.EDGE_TYPES for a in fv.ENTITY_KINDS for b in fv.ENTITY_KINDS]
    edges = spark.createDataFrame(rows, "edge_key string, source string, target string, edge_type string")
    return validate.domain_violations(CodeGraph(ents, edges)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_refused"))


# identities


@query("""SELECT 'sk:v1:sha256:' || sha256('["loom-repository-v1","REPOSITORY","' || r_name || '"]') AS repository_key, r_regionkey FROM region""")
def repository_keys(spark, d):
    return table(spark, d, "region").select(fv.repository_identity(F.concat(F.lit(" "), "r_name", F.lit("\n"))).alias("repository_key"), "r_regionkey")


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@' || lower(p_brand) || '/x/y' WHEN 1 THEN 'fs/promises' WHEN 2 THEN 'pkg' || p_partkey WHEN 3 THEN 'a//b' ELSE 'node:sqlite' END AS spec FROM part),
r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NPM' WHEN 1 THEN 'NODE_BUILTIN' WHEN 2 THEN 'NPM' WHEN 4 THEN 'NODE_BUILTIN' END AS ecosystem,
 CASE p_partkey % 5 WHEN 0 THEN regexp_extract(spec, '^@[^/]*/[^/]*') WHEN 1 THEN 'node:fs' WHEN 2 THEN spec WHEN 4 THEN 'node:sqlite' END AS package, CASE p_partkey % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'promises' END AS subpath FROM s)
SELECT *, CASE WHEN package IS NOT NULL THEN 'sk:v1:sha256:' || sha256('["loom-package-v1","EXTERNAL_PACKAGE","' || ecosystem || '","' || package || '"]') END AS package_key FROM r""")
def package_keys(spark, d):
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    spec = F.when(m == 0, F.concat(F.lit("@"), F.lower("p_brand"), F.lit("/x/y"))).when(m == 1, "fs/promises").when(m == 2, F.concat(F.lit("pkg"), k)).when(m == 3, "a//b").otherwise("node:sqlite")
    r = table(spark, d, "part").select("p_partkey", fv.package_reference(spec).alias("r")).select("p_partkey", "r.*")
    return r.select("*", fv.package_identity(F.col("ecosystem"), F.col("package")).alias("package_key"))


@query("""SELECT conv_id, turn, 'sk:v1:sha256:' || sha256('["loom-anonymous-v1","c/' || conv_id || '","FUNCTION","parent:' || conv_id || '","' || role || '#' || occurrence || '","lf:v1:sha256:' || sha256(replace(text, chr(13), chr(10))) || '"]') AS stable_key
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occurrence FROM conversations)""")
def anonymous_keys(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("role", F.concat("role", F.lit("#"), F.row_number().over(w).cast("string")))
    conv = F.col("conv_id").cast("string")
    return c.select("conv_id", "turn", fv.anonymous_identity(F.concat(F.lit("c/"), conv), F.lit("FUNCTION"), F.concat(F.lit("parent:"), conv), F.col("role"), fv.local_fingerprint(F.col("text"))).alias("stable_key"))


@query(carrier.sql("""SELECT edge_key AS carrier_key, 'ek:v1:sha256:' || sha256('["loom-edge-v1","' || source || '","' || target || '","' || edge_type || '","carrier","1","tables","1",' ||
 CASE WHEN start_line IS NULL THEN '"NO_EVIDENCE"' ELSE '"' || source || '.ts",' || start_line || ',1,' || start_line || ',9,"SYNTAX"' END || ']') AS occurrence_key FROM edge WHERE edge_type IN ('CALLS', 'IMPORTS', 'DEPENDS_ON')"""))
def edge_occurrence_keys(spark, d):
    e = carrier.edges(spark, d, ("CALLS", "IMPORTS", "DEPENDS_ON"))
    line = F.col("start_line")
    path = F.when(line.isNotNull(), F.concat("source", F.lit(".ts")))
    resolver = [F.lit("carrier"), F.lit("1"), F.lit("tables"), F.lit("1")]
    evidence = [path, line, F.lit(1), line, F.lit(9), F.lit("SYNTAX")]
    return e.select(F.col("edge_key").alias("carrier_key"), fv.edge_identity(F.col("source"), F.col("target"), F.col("edge_type"), resolver, evidence).alias("occurrence_key"))


def _json_text(column: str) -> str:
    """SQL for a JSON string of text without control characters but line ends and tabs."""
    return f"""'"' || replace(replace(replace(replace(replace(replace({column}, '\\', '\\\\'), '"', '\\"'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), '\\n'), chr(9), '\\t') || '"'"""


@query(f"""SELECT doc_id, 'df:v1:sha256:' || sha256('{{"defaultExport":false,"exported":' || (doc_id % 2 = 0)::VARCHAR || ',"heritage":[],"kind":"FUNCTION","modifiers":[],"normalizedDeclarationText":' || {_json_text('substr(text, 1, 60)')} || ',"overloads":[],"parameters":[],"returnType":null,"schemaVersion":1,"typeParameters":[],"visibility":null}}') AS declaration,
 'if:v1:sha256:' || sha256('{{"kind":"FUNCTION","normalizationVersion":"tokens-v1","normalizedBody":' || {_json_text('text')} || ',"schemaVersion":1}}') AS implementation FROM documents WHERE text IS NOT NULL""")
def document_fingerprints(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fv.declaration_fingerprint(F.lit("FUNCTION"), F.col("doc_id") % 2 == 0, F.lit(False), F.substring(text, 1, 60)).alias("declaration"), fv.implementation_fingerprint(F.lit("FUNCTION"), F.lit("tokens-v1"), text).alias("implementation"))


@query(carrier.sql("""SELECT stable_key, '{"kind":"' || kind || '","name":"' || name || '","stable_key":"' || stable_key || '"}' AS json FROM ent"""))
def graph_json_rows(spark, d):
    return graph_json.json_rows(carrier.entities(spark, d), "stable_key").select(F.col("key").alias("stable_key"), "json")


@query("SELECT p_partkey, regexp_matches(split_part(p_name, ' ', 1), '^[A-Z][A-Za-z0-9]*$') AS pascal, CASE WHEN p_size = 50 THEN 'EXACT' WHEN p_size >= 40 THEN 'HIGH' WHEN p_size >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level, split_part(p_type, ' ', 1) || '/' || p_brand AS folder, p_name AS base FROM part")
def name_predicates(spark, d):
    path = F.concat(F.substring_index("p_type", " ", 1), F.lit("/"), "p_brand", F.lit("/"), "p_name")
    return table(spark, d, "part").select("p_partkey", fv.pascal_case(F.substring_index("p_name", " ", 1)).alias("pascal"), fv.confidence_level(F.col("p_size") / 50).alias("level"), fv.directory_name(path).alias("folder"), fv.base_name(path).alias("base"))


# resolution

_SPEC = "CASE l_linenumber % 6 WHEN 0 THEN './f' || l_partkey WHEN 1 THEN '../m' || (l_suppkey % 7) || '/f' || l_partkey || '.js' WHEN 2 THEN '@w/p' || (l_suppkey % 9) WHEN 3 THEN '@w/p' || (l_suppkey % 9) || '/dist/f' || l_partkey || '.js' WHEN 4 THEN 'lib' || l_partkey || '/sub' ELSE '#own' || l_partkey END"


@query(f"""WITH i AS (SELECT DISTINCT 'm' || (l_orderkey % 7) || '/src/a.ts' AS file_path, {_SPEC} AS specifier, l_linenumber % 6 AS k, l_partkey AS p, l_suppkey AS s, l_orderkey % 7 AS o FROM lineitem),
f AS (SELECT 'm' || (p_partkey % 7) || '/src/f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END AS path FROM part UNION SELECT 'm' || n || '/src/index.ts' FROM (VALUES (0), (1), (2), (3), (4)) v(n)
 UNION SELECT 'm' || (p_partkey % 7) || '/f' || p_partkey || '.ts' FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT file_path, specifier, k, unnest(CASE k WHEN 0 THEN ['m' || o || '/src/f' || p || '.ts', 'm' || o || '/src/f' || p || '.tsx', 'm' || o || '/src/f' || p || '/index.js']
  WHEN 1 THEN ['m' || o || '/m' || (s % 7) || '/f' || p || '.ts']
  WHEN 2 THEN ['m' || (s % 9) || '/src/index.ts']
  WHEN 3 THEN ['m' || (s % 9) || '/src/f' || p || '.ts', 'm' || (s % 9) || '/src/f' || p || '.tsx'] END) AS path, unnest(CASE k WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [1] WHEN 2 THEN [1] WHEN 3 THEN [1, 2] END) AS pos FROM i WHERE k < 4),
h AS (SELECT file_path, specifier, min(struct_pack(pos := pos, path := c.path)).path AS file FROM c JOIN f ON c.path = f.path GROUP BY 1, 2)
SELECT DISTINCT file_path, specifier, CASE WHEN file IS NOT NULL THEN 'FILE' WHEN k = 4 OR (k IN (2, 3) AND s % 9 >= 7) THEN 'EXTERNAL_PACKAGE' ELSE 'UNRESOLVED' END AS kind,
 coalesce(file, CASE WHEN k = 4 THEN 'lib' || p WHEN k IN (2, 3) AND s % 9 >= 7 THEN '@w/p' || (s % 9) END) AS target, CASE WHEN file IS NOT NULL OR k = 4 OR (k IN (2, 3) AND s % 9 >= 7) THEN NULL WHEN k = 5 THEN 'UNSUPPORTED_SYNTAX' ELSE 'OUTSIDE_ANALYSIS_SCOPE' END AS reason
FROM i LEFT JOIN h USING (file_path, specifier)""")
def specifier_resolution(spark, d):
    imports = table(spark, d, "lineitem").select(F.expr("concat('m', l_orderkey % 7, '/src/a.ts') AS file_path"), F.expr(_SPEC.replace("'lib'", "'lib'") + " AS specifier"))
    part = table(spark, d, "part")
    files = part.select(F.expr("concat('m', p_partkey % 7, '/src/f', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END) AS path"))
    files = files.union(spark.range(5).select(F.expr("concat('m', id, '/src/index.ts')"))).union(part.where("p_partkey % 2 = 0").select(F.expr("concat('m', p_partkey % 7, '/f', p_partkey, '.ts')")))
    packages = spark.range(7).select(F.expr("concat('@w/p', id) AS name"), F.expr("concat('m', id) AS root"), F.lit("./dist/index.js").alias("entry"))
    return resolve.resolve_imports(imports, files, packages)


@query("""WITH RECURSIVE own AS (SELECT DISTINCT 'c' || o_custkey AS file, 'o' || o_orderkey AS entity FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 5 = 0),
star AS (SELECT 'c' || c_custkey AS file, 'c' || (c_custkey * 7 % 100 + 1) AS target FROM customer WHERE c_custkey % 2 = 0),
ex AS (SELECT file, entity FROM own UNION SELECT s.file, x.entity FROM ex x JOIN star s ON s.target = x.file) SELECT file, entity FROM ex""")
def star_reexport_fixpoint(spark, d):
    own = table(spark, d, "orders").where("o_custkey % 3 = 0 AND o_orderkey % 5 = 0").select(F.expr("concat('c', o_custkey) AS file"), F.expr("concat('o', o_orderkey) AS entity"))
    stars = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.expr("concat('c', c_custkey) AS file"), F.expr("concat('c', c_custkey * 7 % 100 + 1) AS target"))
    return resolve.star_exports(own, stars, own.limit(0))


@query("""WITH m AS (SELECT DISTINCT 'd' || (l_partkey % 4) || '/x/' || l_partkey AS file_path, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'tsconfig.json' WHEN 2 THEN 'd' || (l_partkey % 4) || '/tsconfig.json' ELSE 'd' || (l_suppkey % 3) || '/x/tsconfig.json' END AS config_path, l_suppkey % 10 = 3 AS is_root FROM lineitem),
f AS (SELECT *, regexp_replace(coalesce(config_path, ''), '/?[^/]*$', '') AS folder FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY NOT is_root, NOT (config_path IS NOT NULL AND (folder = '' OR starts_with(file_path, folder || '/'))), -length(folder), coalesce(config_path, '~')) AS r FROM f)
SELECT file_path, config_path FROM r WHERE r = 1""")
def program_preference(spark, d):
    config = "CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'tsconfig.json' WHEN 2 THEN concat('d', l_partkey % 4, '/tsconfig.json') ELSE concat('d', l_suppkey % 3, '/x/tsconfig.json') END AS config_path"
    return resolve.preferred_program(table(spark, d, "lineitem").select(F.expr("concat('d', l_partkey % 4, '/x/', l_partkey) AS file_path"), F.expr(config), (F.col("l_suppkey") % 10 == 3).alias("is_root")).distinct())


@query("""WITH e AS (SELECT 's' || s_nationkey AS file_path, CASE s_suppkey % 4 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'CLASS' WHEN 2 THEN 'VARIABLE' ELSE 'ENUM' END AS kind, 'n' || (s_suppkey % 3) AS name, s_name AS stable_key FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY CASE kind WHEN 'FUNCTION' THEN 1 WHEN 'VARIABLE' THEN 3 ELSE 4 END, stable_key) AS r FROM e WHERE kind <> 'ENUM')
SELECT file_path, name, stable_key FROM r WHERE r = 1""")
def symbol_lookup(spark, d):
    kind = "CASE s_suppkey % 4 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'CLASS' WHEN 2 THEN 'VARIABLE' ELSE 'ENUM' END AS kind"
    e = table(spark, d, "supplier").select(F.expr("concat('s', s_nationkey) AS file_path"), F.expr(kind), F.expr("concat('n', s_suppkey % 3) AS qualified_name"), F.col("s_name").alias("stable_key"))
    return resolve.symbols(e.select("file_path", F.col("qualified_name").alias("name")).distinct(), e)


@query("""SELECT 'f' || o_custkey AS file_path, 'l' || l_partkey AS local, min('e' || p_partkey || '.' || p_size) AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey % 10 = l_partkey % 10 AND CASE WHEN l_linenumber = 1 THEN p_partkey % 20 = 3 ELSE p_size = l_linenumber END GROUP BY 1, 2""")
def import_bindings(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    i = i.select(F.expr("concat('f', o_custkey) AS file_path"), (F.col("l_partkey") % 10).alias("target_file"), F.expr("CASE WHEN l_linenumber = 1 THEN 'default' ELSE cast(l_linenumber AS string) END AS imported"), F.expr("concat('l', l_partkey) AS local"))
    e = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("file"), F.col("p_size").cast("string").alias("name"), (F.col("p_partkey") % 20 == 3).alias("default_export"), F.expr("concat('e', p_partkey, '.', p_size) AS entity"))
    return resolve.bindings(i, e)


# comparison of graphs


@query(carrier.sql(f""", ex AS (SELECT * FROM edge WHERE edge_type = 'CALLS' AND start_line <= 3), ac AS (SELECT * FROM edge WHERE edge_type = 'CALLS' AND start_line >= 2),
least AS (SELECT source, target, max(confidence) AS least FROM ex GROUP BY 1, 2), q AS (SELECT DISTINCT a.source, a.target FROM ac a LEFT JOIN least l ON a.source = l.source AND a.target = l.target WHERE least IS NULL OR confidence >= least),
x AS (SELECT DISTINCT source, target FROM ex), n AS (SELECT count(*) AS tp FROM x JOIN q USING (source, target)), c AS (SELECT 'edges' AS part, tp, (SELECT count(*) FROM q) - tp AS fp, (SELECT count(*) FROM x) - tp AS fn FROM n
UNION ALL SELECT 'entities', count(*) FILTER (kind <> 'MODULE' AND kind <> 'FILE'), count(*) FILTER (kind = 'FILE'), count(*) FILTER (kind = 'MODULE') FROM ent) SELECT *, {_METRICS} FROM c"""))
def golden_graph_comparison(spark, d):
    g = carrier.graph(spark, d, ("CALLS",))
    expected = CodeGraph(g.entities.where("kind <> 'FILE'"), _placed(g.edges.where("start_line <= 3")))
    actual = CodeGraph(g.entities.where("kind <> 'MODULE'"), _placed(g.edges.where("start_line >= 2")))
    return compare.graph_comparison(expected, actual, minimum=True)


def _placed(edges):
    return edges.withColumns({"file_path": F.col("source"), "start_column": F.lit(1), "end_line": F.col("start_line"), "end_column": F.lit(9)})


@query(carrier.sql("""SELECT 'unexpected' AS side, source, target FROM (SELECT DISTINCT source, target FROM edge WHERE edge_type = 'REFERENCES' AND start_line >= 2) WHERE (source, target) NOT IN (SELECT (source, target) FROM edge WHERE edge_type = 'REFERENCES' AND start_line <= 2)
UNION ALL SELECT 'missing', source, target FROM (SELECT DISTINCT source, target FROM edge WHERE edge_type = 'REFERENCES' AND start_line <= 2) WHERE (source, target) NOT IN (SELECT (source, target) FROM edge WHERE edge_type = 'REFERENCES' AND start_line >= 2)"""))
def golden_mismatches(spark, d):
    e = carrier.edges(spark, d, ("REFERENCES",))
    return compare.mismatches(e.where("start_line <= 2"), e.where("start_line >= 2"), ["source", "target"])


@query("""WITH f AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
SELECT k AS id, k % 4 <> 3 AND (k % 4 <> 1 OR r = k % 5) AND (k % 4 <> 2 OR r <> k % 5) AS passed,
 CASE WHEN k % 4 = 3 THEN 'source selector matched 0 entities' WHEN k % 4 = 1 AND r <> k % 5 THEN 'expected edge is absent' WHEN k % 4 = 2 AND r = k % 5 THEN 'forbidden edge is present' ELSE 'passed' END AS message FROM f""")
def fact_assertions(spark, d):
    g = carrier.graph(spark, d, ("CONTAINS",))
    ents = g.entities.select("stable_key", "kind", F.lit(None).cast("string").alias("file_path"), F.col("stable_key").alias("qualified_name"))
    k = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    kind = F.when(k % 4 == 1, "EDGE").when(k % 4 == 2, "EDGE_ABSENT").otherwise("ENTITY")
    source = F.when(k % 4 == 0, F.concat(F.lit("nation:"), k.cast("string"))).when(k % 4 == 3, F.lit("nowhere")).otherwise(F.concat(F.lit("region:"), (k % 5).cast("string")))
    facts = table(spark, d, "nation").select(k.alias("id"), kind.alias("kind"), none.alias("source_path"), F.when(k % 4 == 0, "FILE").otherwise("MODULE").alias("source_kind"), source.alias("source_name"), none.alias("target_path"), F.lit("FILE").alias("target_kind"), F.concat(F.lit("nation:"), k.cast("string")).alias("target_name"), F.lit("CONTAINS").alias("edge_type"), F.lit(0.5).alias("minimum_confidence"), none.alias("target_text"), none.alias("reason"))
    unresolved = spark.createDataFrame([], "source string, edge_type string, target_text string, reason string")
    return compare.fact_results(CodeGraph(ents, g.edges), unresolved, facts)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > o_orderkey % 6 ")
def evidence_beyond_files(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    files = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 6).alias("n_lines"))
    return validate.evidence_beyond_file(li, files).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH f AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'src/a' || page_id || '.ts' WHEN 1 THEN 'dist/a.js' WHEN 2 THEN 'p/package.json' WHEN 3 THEN 'src/b' || page_id || '.min.js' WHEN 4 THEN 'tests/Baselines/x.ts' WHEN 5 THEN 'tsconfig.base.json' WHEN 6 THEN 'data/x.json' ELSE 'src/c' || page_id || '.d.MTS' END AS path, html FROM pages)
SELECT path, CASE WHEN page_id % 8 IN (2, 5) THEN 'PROJECT_CONFIGURATION' ELSE 'SOURCE' END AS role, CASE page_id % 8 WHEN 2 THEN 'JSON' WHEN 5 THEN 'JSON' WHEN 3 THEN 'JAVASCRIPT' ELSE 'TYPESCRIPT' END AS format,
 CASE WHEN strlen(html) > 4000 THEN 'FILE_TOO_LARGE' WHEN page_id % 8 = 3 THEN 'GENERATED_SOURCE_SKIPPED' END AS skip, count(*) AS n FROM f WHERE page_id % 8 NOT IN (1, 4, 6) GROUP BY 1, 2, 3, 4""")
def scan_classification(spark, d):
    path = "CASE page_id % 8 WHEN 0 THEN concat('src/a', page_id, '.ts') WHEN 1 THEN 'dist/a.js' WHEN 2 THEN 'p/package.json' WHEN 3 THEN concat('src/b', page_id, '.min.js') WHEN 4 THEN 'tests/Baselines/x.ts' WHEN 5 THEN 'tsconfig.base.json' WHEN 6 THEN 'data/x.json' ELSE concat('src/c', page_id, '.d.MTS') END AS path"
    files = table(spark, d, "pages").select(F.expr(path), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return classified(files, max_bytes=4000).groupBy("path", "role", "format", "skip").agg(F.count(F.lit(1)).alias("n"))


@query(carrier.sql("""SELECT edge_key, s.kind AS source_kind, t.kind AS target_kind FROM edge JOIN ent s ON s.stable_key = source JOIN ent t ON t.stable_key = target WHERE edge_type = 'CONTAINS'"""))
def edges_with_ends(spark, d):
    g = carrier.graph(spark, d, ("CONTAINS",))
    k = g.entities.select("stable_key", "kind")
    s, t = (k.select(F.col("stable_key").alias(c), F.col("kind").alias(c + "_kind")) for c in ("source", "target"))
    return g.edges.join(s, "source").join(t, "target").select("edge_key", "source_kind", "target_kind")


@query("SELECT c_nationkey AS repository, n_name AS name, event_id AS snapshot_id FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def snapshots_of_repositories(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("repository"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("repository"), F.col("n_name").alias("name"))
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("snapshot_id")).join(c, "user_id").join(n, "repository").select("repository", "name", "snapshot_id")


@query("SELECT event_type AS phase, count(*) AS runs, round(sum(value), 4) AS total, floor(count(*) * 1000 / sum(value) + 0.5)::BIGINT AS per_second FROM events WHERE value > 0 GROUP BY 1")
def phase_totals(spark, d):
    e = table(spark, d, "events").where("value > 0").groupBy(F.col("event_type").alias("phase")).agg(F.count(F.lit(1)).alias("runs"), F.sum("value").alias("v"))
    return e.select("phase", "runs", F.round("v", 4).alias("total"), fv.per_second_rounded(F.col("runs"), F.col("v")).alias("per_second"))


# retrieval, chunks, blobs read back


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents), c AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS l, unnest(words) AS term FROM w) WHERE term IN ('thtion', 'der', 'que') GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM tf JOIN df USING (term), c GROUP BY 1""")
def bm25_search(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    return retrieval.bm25(texts, ["thtion", "der", "que"]).select(F.col("item").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH w AS (SELECT c_custkey AS id, unnest({_WORDS.format('c_name')}) AS t FROM customer), g AS (SELECT DISTINCT id, substr('  ' || t || ' ', i, 3) AS gram FROM (SELECT id, t, unnest(range(1, length(t) + 2)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), m AS (SELECT x.id AS item, y.id AS q, count(*) AS k FROM g x JOIN g y USING (gram) WHERE y.id % 100 = 0 GROUP BY 1, 2)
SELECT q, item, round(k / (a.n + b.n - k), 6) AS similarity FROM m JOIN n a ON a.id = item JOIN n b ON b.id = q WHERE k / (a.n + b.n - k) >= 0.6""")
def trigram_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("name"))
    q = c.where("item % 100 = 0").select(F.col("item").alias("q"), "name")
    return retrieval.trigram_search(c, q, 0.6).select("q", "item", F.round("similarity", 6).alias("similarity"))


_STEP = "SELECT source AS a, target AS b, CASE edge_type WHEN 'CALLS' THEN 0.5 ELSE 0.25 END AS w FROM edge WHERE edge_type IN ('CALLS', 'CONTAINS')"


@query(carrier.sql(f""", st AS (SELECT a, b, w FROM ({_STEP}) UNION SELECT b, a, w FROM ({_STEP})), h AS (SELECT 'order:' || o_orderkey AS k FROM orders WHERE o_orderkey % 100 = 0),
one AS (SELECT k, 1.0 AS s, 0 AS hop FROM h UNION ALL SELECT b, w, 1 FROM h JOIN st ON a = k), b1 AS (SELECT k, max(s) AS s FROM one GROUP BY 1), f1 AS (SELECT k, s, min(hop) AS hop FROM one JOIN b1 USING (k, s) GROUP BY 1, 2),
two AS (SELECT * FROM f1 UNION ALL SELECT b, s * w, 2 FROM f1 JOIN st ON a = k WHERE hop = 1), b2 AS (SELECT k, max(s) AS s FROM two GROUP BY 1)
SELECT k AS stable_key, s::DOUBLE AS score, min(hop) AS hop FROM two JOIN b2 USING (k, s) GROUP BY 1, 2"""))
def graph_expansion(spark, d):
    hits = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(carrier.key("order", "o_orderkey").alias("stable_key"), F.lit(1.0).alias("score"))
    return retrieval.expand(carrier.graph(spark, d, ("CALLS", "CONTAINS")), hits, {"CALLS": 0.5, "CONTAINS": 0.25}, 2)


@query("""WITH r AS (SELECT doc_id, unnest([1, 2, 5]) AS a, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id::VARCHAR AS path, a, a + 2 AS b, array_to_string(list_slice(l, a, a + 2), chr(10)) AS chunk FROM r WHERE a <= len(l))
SELECT path, a AS start_line, b AS end_line, sha256(path || '|e' || a || '|' || a || '|' || b || '|' || chunk) AS chunk_id FROM c""")
def semantic_chunks(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    ranges = files.select("path", F.explode(F.array(*map(F.lit, (1, 2, 5)))).alias("start_line")).withColumn("end_line", F.col("start_line") + 2).withColumn("entity", F.concat(F.lit("e"), F.col("start_line")))
    return retrieval.chunks(files, ranges).select("path", "start_line", "end_line", "chunk_id")


@query("""WITH b AS (SELECT min(page_id) AS page_id, sha256(html) AS h FROM pages WHERE html IS NOT NULL GROUP BY sha256(html)), e AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'source/' || h || page_id ELSE 'source/sha256/' || substr(h, 1, 2) || '/' || h END AS k FROM b), s AS (SELECT page_id % 13 = 0 AS bad, page_id % 11 = 0 AS gone, page_id % 7 = 0 AS longer, page_id % 5 = 0 AS other FROM e)
SELECT CASE WHEN bad THEN 'MALFORMED_KEY' WHEN gone THEN 'MISSING' WHEN longer THEN 'WRONG_LENGTH' WHEN other THEN 'WRONG_HASH' ELSE 'VERIFIED' END AS status, count(*) AS n FROM s GROUP BY 1""")
def blob_verification(spark, d):
    p = table(spark, d, "pages").where("html IS NOT NULL").groupBy(F.sha2("html", 256).alias("h")).agg(F.min("page_id").alias("page_id"), F.any_value("html").alias("html"))
    p = p.withColumn("object_key", F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("source/"), "h", F.col("page_id").cast("string"))).otherwise(fv.object_key(F.col("h"))))
    body = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("x"))).when(F.col("page_id") % 5 == 0, F.translate("html", "aeio", "bfjp")).otherwise(F.col("html"))
    stored = p.where("page_id % 11 <> 0").select("object_key", body.cast("binary").alias("content"))
    return lifecycle.verify_blobs(stored, p.select("object_key", F.octet_length("html").alias("n_bytes"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
