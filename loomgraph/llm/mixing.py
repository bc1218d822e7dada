"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with ``n`` of ``N`` documents and target share ``w`` gets the mean repetition rate ``w * N * size / n``.  Each document's
count is the inverse of the Poisson distribution with that mean at a uniform number hashed from (seed, doc_id): no state, no order,
the same for every run and partitioning.  Documents are exploded by their counts and shuffled globally by another hash: partitions are
equal ranges of the hash, so rows are dealt out without a pass that samples them, and each partition is sorted.

The table of a source's cumulative probabilities ends where the rest is below the step of the uniform number (2**-52), so no
count is cut off.  Its length grows with the rate; the tables are joined to the documents by broadcast only if all of them together,
which is checked, have at most ``BROADCAST_ENTRIES`` numbers; beyond, by an ordinary join, whose hot sources adaptive execution splits.

Defined results: a null source is a source of its own; null or repeated doc_ids draw by their value, so repeated rows repeat alike;
without documents there is no output; sources that ``weights`` doesn't name get weight 0.  Extra columns are kept, whatever their
names.  The added columns are copy_no and shuffle_key; input columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

SEED = "mix-1"
#: Without explicit weights a source's target share is proportional to n ** TEMPERATURE.
TEMPERATURE = 0.5
#: Numbers of 8 bytes.
BROADCAST_ENTRIES = 1_000_000


def uniform(seed: str, *cols):
    """52 hashed bits as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0) -> DataFrame:
    """mix_source, rate: mean repetitions per document of each source."""
    n = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        pairs = [F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        n = n.withColumn("w", F.coalesce(*pairs, F.lit(0.0)))
    total = n.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * F.lit(float(size)) / F.col("n")).otherwise(0.0)
    return n.join(F.broadcast(total)).select("mix_source", rate.alias("rate"))


def cumulative(rate_table: DataFrame) -> DataFrame:
    """Adds cdf: P(count <= k) for k = 0, 1, ... until what is left is below 2**-53.

    A row per source and k: the logarithm of k! is a running sum, so the work grows with the table and no power underflows.
    """
    last = (F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    rows = rate_table.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    w = Window.partitionBy("mix_source", "rate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.greatest("k", F.lit(1))))
    p = rows.withColumn("log_p", F.sum(step).over(w)).withColumn("c", F.sum(F.exp("log_p")).over(w))
    return p.groupBy("mix_source", "rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED, size: float = 1.0) -> DataFrame:
    """``docs`` repeated to the target weights, in a global random order; adds copy_no (from 1) and shuffle_key."""
    cdf = materialize(cumulative(rates(docs, weights, temperature, size).where("rate > 0")), "mix-rates")
    small = (cdf.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_ENTRIES
    kept = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    # the document stays one column until its copies are made, so that no name of it meets one of the tables'
    d = docs.select(F.struct(*kept).alias("doc"))
    joined = d.join(F.broadcast(cdf) if small else cdf, F.col("doc.source").eqNullSafe(F.col("mix_source")))
    n = F.size(F.filter("cdf", lambda c: c <= F.col("mix_u")))
    drawn = joined.select("doc", "cdf", uniform(seed, "doc.doc_id").alias("mix_u")).select("doc", n.alias("mix_n")).where("mix_n > 0")
    copies = drawn.select("doc", F.explode(F.expr("sequence(1, mix_n)")).alias("copy_no"))
    text = F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null")), F.col("copy_no").cast("string"))
    keyed = copies.select("doc", "copy_no", F.md5(text.cast("binary")).alias("shuffle_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * F.lit(parts / 2**32)).cast("int")
    dealt = keyed.repartitionById(parts, part).sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("doc").getField(c).alias(c) for c in kept], "copy_no", "shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE n AS (SELECT source AS mix_source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT mix_source, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT mix_source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM r
      UNION ALL SELECT mix_source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM p
      WHERE k < rate + 12 * sqrt(rate) + 40),
u AS (SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS mix_u FROM documents),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS copies
      FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.mix_source AND p.cdf <= u.mix_u GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM c)
SELECT *, md5('mix-1-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy_no::VARCHAR) AS shuffle_key FROM e
"""
