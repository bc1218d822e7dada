"""Set comparison, rank fusion and association measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.sources.shared import materialize


def counts(expected: DataFrame, actual: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of two sets of keys, overall or per group; null keys equal null keys."""
    by = by or []
    both = expected.select(*by, *keys, F.lit(1).alias("e"), F.lit(0).alias("a")).union(actual.select(*by, *keys, F.lit(0).alias("e"), F.lit(1).alias("a")))
    seen = both.groupBy(*by, *keys).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    agg = [F.count_if(F.expr(c)).alias(n) for n, c in (("tp", "e = 1 and a = 1"), ("fp", "e = 0"), ("fn", "a = 0"))]
    return seen.groupBy(*by).agg(*agg) if by else seen.agg(*agg)


def metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    """Adds precision, recall, f1 to tp, fp, fn.  No actual rows: precision 1 if none were expected, else 0; none expected: recall 1."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p = F.when(tp + fp == 0, F.when(tp + fn == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return df.select("*", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def above_golden(actual: DataFrame, golden: DataFrame, key: str = "edge_key") -> DataFrame:
    """Actual edges without those below the largest confidence that the golden set asks of their key; unknown edges stay."""
    least = golden.groupBy(key).agg(F.max("confidence").alias("least"))
    return actual.join(least, key, "left").where("least IS NULL OR confidence >= least").drop("least")


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds rank (from 1) within ``group`` in the given order, without a group in one task.

    Rows are dealt by ranges of (group, order) and numbered there; each range is told how many rows of its first group came before.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumns({"__part": F.spark_partition_id(), "__line": F.monotonically_increasing_id()}), "ranked")
    # a written table of one row a group and range: ranges times groups at most, and about ranges plus groups in fact
    ends = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__line").alias("__first"))
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.withColumn("__ahead", F.coalesce(F.sum("__n").over(w), F.lit(0))).select(F.col(group).alias("__group"), F.col("__part").alias("__p"), "__first", "__ahead")
    joined = dealt.join(ahead, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("rank", F.col("__line") - F.col("__first") + F.col("__ahead") + 1).drop("__part", "__line", "__group", "__p", "__first", "__ahead")


def reciprocal_rank_fusion(channels: DataFrame, k: int = 60) -> DataFrame:
    """(channel, item, score) -> (item, rrf): sum over channels of 1 / (k + rank); ties by item."""
    placed = ranked(channels, "channel", F.desc("score"), F.col("item"))
    return placed.groupBy("item").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def graph_comparison(expected, actual, evidence: bool = False, minimum: bool = False) -> DataFrame:
    """(part, tp, fp, fn, precision, recall, f1) of two graphs: entities by key, edges by type and ends, with ``evidence`` by place too.

    ``minimum``: actual edges below the largest confidence that the expected ones ask of their key don't count.
    """
    place = ["file_path", "start_line", "start_column", "end_line", "end_column"]
    keys = ["edge_type", "source", "target", *(place if evidence else [])]
    mine, theirs = actual.edges, expected.edges
    if minimum:
        least = theirs.groupBy(*keys).agg(F.max("confidence").alias("least"))
        same = F.lit(True)
        for c in keys:
            same = same & mine[c].eqNullSafe(least[c])
        mine = mine.join(least, same, "left").where("least IS NULL OR confidence >= least").select(*[mine[c] for c in keys])
    parts = {"entities": counts(expected.entities, actual.entities, ["stable_key"]), "edges": counts(theirs, mine, keys)}
    out = None
    for name, c in parts.items():
        row = metrics(c).select(F.lit(name).alias("part"), "*")
        out = row if out is None else out.union(row)
    return out


def set_comparison(expected: DataFrame, actual: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The same row for other sets: unresolved relationships by (source, edge_type, target_text, reason), diagnostics by code."""
    return metrics(counts(expected, actual, keys)).select(F.lit(part).alias("part"), "*")


def mismatches(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): what is missing from the actual set, and what is unexpected in it."""
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).union(actual.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a")))
    seen = both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("a").alias("a")).where("e <> a")
    return seen.select(F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("side"), *keys)


def is_perfect(comparison: DataFrame) -> DataFrame:
    """(perfect): whether nothing is missing or unexpected in any part."""
    return comparison.agg(F.coalesce(F.bool_and((F.col("fp") == 0) & (F.col("fn") == 0)), F.lit(True)).alias("perfect"))


def fact_results(graph, unresolved: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, passed, message) of facts about a graph.

    facts: id, kind (ENTITY, EDGE, EDGE_ABSENT, UNRESOLVED), source_path, source_kind, source_name, target_path, target_kind,
    target_name, edge_type, minimum_confidence, target_text, reason.  A selector must match exactly one entity; a fact without a
    source (UNRESOLVED only) asks for a relationship without one.
    """
    named = graph.entities.groupBy("file_path", "kind", "qualified_name").agg(F.count(F.lit(1)).alias("n"), F.min("stable_key").alias("key"))

    def side(df: DataFrame, s: str) -> DataFrame:
        e = named.select(F.col("file_path").alias("p"), F.col("kind").alias("k"), F.col("qualified_name").alias("q"), F.col("n").alias(f"{s}_n"), F.col("key").alias(f"{s}_key"))
        same = F.col(f"{s}_path").eqNullSafe(F.col("p")) & (F.col(f"{s}_kind") == F.col("k")) & (F.col(f"{s}_name") == F.col("q"))
        return df.join(e, same, "left").drop("p", "k", "q")

    f = side(side(facts, "source"), "target")
    e = graph.edges.groupBy(F.col("source").alias("es"), F.col("target").alias("et"), F.col("edge_type").alias("ek")).agg(F.max("confidence").alias("best"))
    f = f.join(e, (F.col("source_key") == F.col("es")) & (F.col("target_key") == F.col("et")) & (F.col("edge_type") == F.col("ek")), "left")
    u = unresolved.select(F.col("source").alias("us"), F.col("edge_type").alias("uk"), F.col("target_text").alias("ut"), F.col("reason").alias("ur")).distinct().withColumn("held", F.lit(True))
    f = f.join(u, F.col("source_key").eqNullSafe(F.col("us")) & (F.col("edge_type") == F.col("uk")) & F.col("target_text").eqNullSafe(F.col("ut")) & (F.col("reason") == F.col("ur")), "left")
    one = lambda s: F.coalesce(F.col(f"{s}_n"), F.lit(0)) == 1
    edge = F.coalesce(F.col("best") >= F.coalesce("minimum_confidence", F.lit(0.0)), F.lit(False))
    kind = F.col("kind")
    message = (
        F.when((F.col("source_kind").isNotNull() | (kind != "UNRESOLVED")) & ~one("source"), F.concat(F.lit("source selector matched "), F.coalesce(F.col("source_n"), F.lit(0)).cast("string"), F.lit(" entities")))
        .when(kind.isin("EDGE", "EDGE_ABSENT") & ~one("target"), F.concat(F.lit("target selector matched "), F.coalesce(F.col("target_n"), F.lit(0)).cast("string"), F.lit(" entities")))
        .when((kind == "EDGE") & ~edge, "expected edge is absent")
        .when((kind == "EDGE_ABSENT") & edge, "forbidden edge is present")
        .when((kind == "UNRESOLVED") & F.col("held").isNull(), "expected unresolved relationship is absent")
        .when(~kind.isin("ENTITY", "EDGE", "EDGE_ABSENT", "UNRESOLVED"), "unsupported kind of fact")
        .otherwise("passed")
    )
    return f.select("id", (message == "passed").alias("passed"), message.alias("message"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cochange(changes: DataFrame, most_files: int = 50) -> DataFrame:
    """(commit, file) -> (a, b, support, a_to_b, b_to_a, jaccard) for pairs a < b; commits of more than ``most_files`` files are left out.

    The bound keeps a commit's pairs below most_files squared, so no group grows beyond it.
    """
    files = changes.select("commit", "file").distinct()
    size = files.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files).select("commit")
    used = files.join(size, "commit")
    lists = used.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("f"))
    pairs = lists.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("b"))
    support = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))
    n = used.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    j = support.join(n.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "support", (F.col("support") / F.col("na")).alias("a_to_b"), (F.col("support") / F.col("nb")).alias("b_to_a"), (F.col("support") / (F.col("na") + F.col("nb") - F.col("support"))).alias("jaccard"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): ADDED, REMOVED, DECLARATION, IMPLEMENTATION or BOTH; both sides have declaration and implementation fingerprints."""
    b = before.select(F.col(key), F.col("declaration").alias("d0"), F.col("implementation").alias("i0"), F.lit(True).alias("in0"))
    a = after.select(F.col(key), F.col("declaration").alias("d1"), F.col("implementation").alias("i1"), F.lit(True).alias("in1"))
    d, i = ~F.col("d0").eqNullSafe(F.col("d1")), ~F.col("i0").eqNullSafe(F.col("i1"))
    change = F.when(F.col("in0").isNull(), "ADDED").when(F.col("in1").isNull(), "REMOVED").when(d & i, "BOTH").when(d, "DECLARATION").when(i, "IMPLEMENTATION")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")
