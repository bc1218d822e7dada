"""Snapshot lifecycle queries: retention, stale builds, pins, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.values import digest_of_key


def retention(ready: DataFrame, pins: DataFrame, current: DataFrame, now: Column, keep: int = 5) -> DataFrame:
    """READY snapshots (repository, snapshot_id, ready_at) beyond the ``keep`` newest, not current, without an active pin.

    Current and pinned snapshots hold their ranks; a pin (snapshot_id, expires_at) is active while expires_at > now.
    """
    w = Window.partitionBy("repository").orderBy(F.desc("ready_at"), F.desc("snapshot_id"))
    old = ready.withColumn("position", F.row_number().over(w)).where(F.col("position") > keep)
    active = pins.where(F.col("expires_at") > now).select("snapshot_id")
    return old.join(active, "snapshot_id", "left_anti").join(current.select("snapshot_id"), "snapshot_id", "left_anti")


def pin_upsert(pins: DataFrame, renewals: DataFrame) -> DataFrame:
    """Last write wins per (snapshot_id, owner); (written_at, expires_at) come from the newest row."""
    latest = F.max(F.struct("written_at", "expires_at")).alias("p")
    return pins.unionByName(renewals).groupBy("snapshot_id", "owner").agg(latest).select("snapshot_id", "owner", "p.written_at", "p.expires_at")


def blob_tally(existing: DataFrame, put: DataFrame) -> DataFrame:
    """(status, n) of distinct keys put: REUSED where the store has the key, else UPLOADED."""
    have = existing.select("object_key").distinct().withColumn("have", F.lit(True))
    p = put.select("object_key").distinct().join(have, "object_key", "left")
    return p.groupBy(F.when(F.col("have"), "REUSED").otherwise("UPLOADED").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def verify_blobs(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(object_key, content), (object_key, n_bytes) -> (object_key, status): each expected blob read back and hashed.

    MALFORMED_KEY, MISSING, WRONG_LENGTH, WRONG_HASH or VERIFIED, the first that holds; contents are hashed before the join.
    """
    have = stored.select("object_key", F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("length"))
    j = expected.select("object_key", "n_bytes").join(have, "object_key", "left")
    digest = digest_of_key(F.col("object_key"))
    status = F.when(digest.isNull(), "MALFORMED_KEY").when(F.col("digest").isNull(), "MISSING").when(~F.col("length").eqNullSafe(F.col("n_bytes")), "WRONG_LENGTH").when(F.col("digest") != digest, "WRONG_HASH").otherwise("VERIFIED")
    return j.select("object_key", status.alias("status"))


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    return stored.join(referenced.select("object_key"), "object_key", "left_anti")


def content_revision(artifacts: DataFrame) -> DataFrame:
    """One digest of all (path, hash): leaves hashed, put together sorted within 4096 buckets, then the buckets in order.

    No task sees more than a 4096th of the leaves.
    """
    leaf = F.sha2(F.concat(F.col("path"), F.lit("|"), F.col("hash")), 256)
    leaves = artifacts.select(leaf.alias("leaf")).withColumn("bucket", F.substring("leaf", 1, 3))
    joined = F.array_join(F.array_sort(F.collect_list("leaf")), "")
    buckets = leaves.groupBy("bucket").agg(F.sha2(joined, 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "")
    return buckets.agg(F.sha2(ordered, 256).alias("revision"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_artifacts"))


def innermost(inner: DataFrame, outer: DataFrame, group: list[str]) -> DataFrame:
    """inner (group, id, point) -> the tightest outer (group, owner, lo, hi) with lo <= point <= hi; ties by owner.

    The range join is within ``group`` (a file), whose declarations are few.
    """
    j = inner.join(outer, group).where("lo <= point AND point <= hi")
    return j.groupBy(*group, "id").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "owner")).alias("m")).select(*group, "id", "m.owner")
