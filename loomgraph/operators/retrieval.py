"""Search over texts, names and vectors, expansion of hits along edges, and chunks by declared ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.compare import cosine
from loomgraph.operators.graph import CodeGraph
from loomgraph.sources.shared import materialize, release

#: Queries held against all vectors at once, about; a block of them is what is broadcast.
QUERY_BLOCK = 10_000


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(texts: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(item, text) -> (item, score) of the items that hold a term.  Only query terms leave the scan; items are distinct."""
    words = texts.select("item", terms_of(F.col("text")).alias("words")).select("item", F.size("words").alias("length"), F.filter("words", lambda t: t.isin(*terms)).alias("found"))
    corpus = words.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    tf = words.select("item", "length", F.explode("found").alias("term")).groupBy("item", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row, and a row per query term
    j = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return j.groupBy("item").agg(F.sum(part).alias("score"))


def trigrams(name: Column) -> Column:
    """Distinct trigrams of a name's words, each with two spaces before it and one after."""
    padded = F.transform(terms_of(name), lambda t: F.concat(F.lit("  "), t, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def _codes(grams: Column) -> Column:
    """Sorted longs for trigrams: three code points of 21 bits each, so different ones differ."""
    point = lambda g, i: F.ascii(F.substr(g, F.lit(i), F.lit(1))).cast("long")
    return F.array_sort(F.transform(grams, lambda g: F.shiftleft(point(g, 1), 42).bitwiseOR(F.shiftleft(point(g, 2), 21)).bitwiseOR(point(g, 3))))


def trigram_search(names: DataFrame, queries: DataFrame, least: float = 0.3) -> DataFrame:
    """(item, name), (q, name) -> (q, item, similarity) where trigram sets share ``least`` of their union.

    Names of equal sets are one set until the end.  Sets of n and m trigrams must share k = least / (1 + least) * (n + m) of them, so
    they share one of their first n - k + 1 and m - k + 1 in any order common to both; with frequent ones last, few sets meet by chance.
    """
    x, y = (df.select(key, _codes(trigrams(F.col("name"))).alias("g")).where(F.size("g") > 0) for df, key in ((names, "item"), (queries, "q")))
    both_kinds = x.select("g", F.lit(False).alias("asked")).union(y.select("g", F.lit(True)))
    sets = both_kinds.groupBy("g").agg((~F.min("asked")).alias("held"), F.max("asked").alias("asked")).withColumn("sid", F.monotonically_increasing_id())
    sets = materialize(sets, "trigram-sets")
    grams = sets.select("sid", "held", "asked", F.explode("g").alias("gram"))
    often = grams.where("held").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    ordered = grams.join(often, "gram", "left").groupBy("sid", "held", "asked").agg(F.sort_array(F.collect_list(F.struct("c", "gram")))["gram"].alias("g"))
    ordered = materialize(ordered.withColumn("n", F.size("g")), "trigram-order")

    # rounded down a little, so that no pair at the limit is lost
    shared = F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-6)).cast("int")
    alone = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-6)).cast("int")
    held = ordered.where("held").select(F.col("sid").alias("x"), F.col("g").alias("gx"), "n")
    sizes = F.broadcast(held.select("n").distinct())
    asked = ordered.where("asked").select(F.col("sid").alias("y"), F.col("g").alias("gy"), F.col("n").alias("m")).crossJoin(sizes).withColumn("k", shared).where("k <= least(n, m)")
    asked = asked.select("*", F.explode(F.slice("gy", F.lit(1), F.col("m") - F.col("k") + 1)).alias("gram"))
    held = held.where(F.col("n") >= alone).select("*", F.posexplode(F.slice("gx", F.lit(1), F.col("n") - alone + 1)).alias("pos", "gram"))
    met = held.join(asked, ["gram", "n"]).withColumn("both", F.array_intersect("gx", "gy"))
    # most fail at the size; of the others a pair counts at the first trigram it shares
    met = met.where((F.col("pos") <= F.col("n") - F.col("k")) & (F.size("both") >= F.col("k")) & (F.col("both")[0] == F.col("gram")))
    pairs = materialize(met.select("x", "y", "n", "m", F.size("both").alias("both")), "trigram-pairs")
    release(ordered)
    similarity = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    pairs = pairs.select("x", "y", similarity.alias("similarity")).where(F.col("similarity") >= least)
    of = lambda rows, key, sid: rows.join(sets.select("g", F.col("sid").alias(sid)), "g").select(key, sid)
    return pairs.join(of(y, "q", "y"), "y").join(of(x, "item", "x"), "x").select("q", "item", "similarity")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, embedding), (q, qe) -> (q, vec_id, similarity), the k nearest of each query, itself left out; ties by vec_id.

    Exact: blocks of about ``block`` queries, dealt by hash, go against all rows one after another; a task keeps k rows a query.
    """
    blocks = max(1, -(-queries.count() // block))
    held = queries if blocks == 1 else materialize(queries.withColumn("__block", F.pmod(F.xxhash64("q"), F.lit(blocks))), "query-blocks")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), "vec_id")

    def one(part: DataFrame) -> DataFrame:
        s = vectors.join(F.broadcast(part), F.col("vec_id") != F.col("q")).select("q", "vec_id", cosine(F.col("qe"), F.col("embedding")).alias("similarity"))
        return s.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")

    if blocks == 1:
        return one(held)
    return reduce(DataFrame.union, [materialize(one(held.where(F.col("__block") == i).drop("__block")), "nearest") for i in range(blocks)])


def expand(graph: CodeGraph, hits: DataFrame, weights: dict[str, float], hops: int = 1) -> DataFrame:
    """(stable_key, score) -> (stable_key, score, hop): hits and what edges of the weighted types lead to, in either direction.

    A hop multiplies the score by its type's weight; an entity keeps its best score, of equal ones that of fewer hops.
    """
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    e = graph.of_types(*weights).edges.select("source", "target", w[F.col("edge_type")].alias("w"))
    step = e.select(F.col("source").alias("stable_key"), F.col("target").alias("next"), "w").union(e.select("target", "source", "w")).distinct()
    best = F.max(F.struct("score", (-F.col("hop")).alias("less"))).alias("m")
    found = hits.select("stable_key", "score", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        on = found.where(F.col("hop") == hop - 1).join(step, "stable_key").select(F.col("next").alias("stable_key"), (F.col("score") * F.col("w")).alias("score"), F.lit(hop).alias("hop"))
        found = found.union(on).groupBy("stable_key").agg(best).select("stable_key", "m.score", (-F.col("m.less")).alias("hop"))
        if hop < hops:
            found = materialize(found, "expanded")
    return found


def chunks(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, text), (path, entity, start_line, end_line) -> (entity, path, start_line, end_line, chunk, chunk_id).

    Lines count from 1, both included, and end at the text's last; ranges that begin beyond it, or of unknown files, give no row.
    """
    lines = files.select("path", F.split("text", "\n").alias("lines"))
    j = ranges.join(lines, "path").where("start_line >= 1 AND end_line >= start_line AND start_line <= size(lines)")
    text = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    named = j.select("entity", "path", "start_line", "end_line", text.alias("chunk"))
    return named.withColumn("chunk_id", F.sha2(F.concat_ws("|", "path", "entity", "start_line", "end_line", "chunk"), 256))
