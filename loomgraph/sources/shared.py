"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

#: Lets Spark remove an execution's shuffle files when it ends; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.  Where that is unset, a local folder on a local master; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/loomgraph-{os.getpid()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, observed: Observation | None = None, *aggregates) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: cuts lineage and survives lost executors.

    The table replaces the shuffles that led to it, whose files Spark removes at the end of the write.  ``observed`` takes
    ``aggregates`` of the rows on the way, without another pass.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.observe(observed, *aggregates) if observed else df).write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` once what was made of them is written; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
