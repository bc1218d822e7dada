"""Immutable snapshots on any Hadoop file system: partitions of entities and edges, and an append-only log of states.

A snapshot is visible once its READY row is in the log; that row is written last, after the counts were checked, as one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.graph import CodeGraph

LOG = "repository string, snapshot_id string, status string, at timestamp, n_entities long, n_edges long, note string"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, repository, snapshot_id, status, n_entities=None, n_edges=None, note=None) -> None:
        row = self.spark.createDataFrame([(repository, snapshot_id, status, n_entities, n_edges, note)], LOG.replace("at timestamp, ", ""))
        row.withColumn("at", F.current_timestamp()).select(*[c.split()[0] for c in LOG.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except Exception as e:  # no snapshot yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG)
            raise

    def states(self) -> DataFrame:
        """Latest state of each snapshot, with ``current``: the newest READY one of its repository."""
        last = Window.partitionBy("snapshot_id").orderBy(F.desc("at"), F.desc("status"))
        s = self.log().withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
        newest = Window.partitionBy("repository", F.col("status") == "READY").orderBy(F.desc("at"), F.desc("snapshot_id"))
        return s.withColumn("current", (F.col("status") == "READY") & (F.row_number().over(newest) == 1))

    def publish(self, repository: str, snapshot_id: str, graph: CodeGraph) -> None:
        """Write, read back, compare counts, then make it READY; a READY snapshot is reused, a failed one written anew."""
        state = self.states().where(F.col("snapshot_id") == snapshot_id).first()
        if state is not None and state.status == "READY":
            return
        self._append(repository, snapshot_id, "BUILDING")
        try:
            for name, df in (("entities", graph.entities), ("edges", graph.edges)):
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}")
            counted = [self.spark.read.parquet(f"{self.root}/{n}/snapshot_id={snapshot_id}").count() for n in ("entities", "edges")]
            if counted != [graph.entities.count(), graph.edges.count()]:
                raise RuntimeError("counts differ after writing")
        except Exception as e:
            self._append(repository, snapshot_id, "FAILED", note=str(e)[:500])
            raise
        self._append(repository, snapshot_id, "READY", *counted)

    def load(self, snapshot_id: str) -> CodeGraph:
        """READY snapshots only; reads their partitions alone."""
        state = self.states().where((F.col("snapshot_id") == snapshot_id) & (F.col("status") == "READY")).first()
        if state is None:
            raise LookupError(f"{snapshot_id} isn't READY")
        return CodeGraph(*(self.spark.read.parquet(f"{self.root}/{n}/snapshot_id={snapshot_id}") for n in ("entities", "edges")))
