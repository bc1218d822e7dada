"""A graph as one line of canonical JSON, and equality of graphs by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.values import json_boolean, json_number, json_object, json_string
from loomgraph.operators.graph import CodeGraph

_NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


def json_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as an object with its fields in order; nulls stay."""
    value = {c: (json_number if t in _NUMBERS else json_boolean if t == "boolean" else json_string)(F.col(c)) for c, t in rows.dtypes}
    return rows.select(F.col(key).alias("key"), json_object(**value).alias("json"))


def write_graph_json(graph: CodeGraph, to: str) -> str:
    """Write the graph as lines in the order of keys: {"edges":[, edges, ],"entities":[, entities, ],"schemaVersion":1}.

    Joined without line ends they are one JSON document.  The lines are sorted and written by ranges, by as many tasks as the graph needs.
    """
    spark = graph.entities.sparkSession
    mark = lambda place, text: spark.range(1).select(F.lit(place).alias("part"), F.lit("").alias("key"), F.lit(text).alias("json"))
    lines = mark(0, '{"edges":[')
    for place, rows, key, tail in ((1, graph.edges, "edge_key", '],"entities":['), (3, graph.entities, "stable_key", '],"schemaVersion":1}')):
        own = json_rows(rows, key)
        first = own.agg(F.min("key").alias("first"))
        own = own.join(F.broadcast(first)).select(F.lit(place).alias("part"), "key", F.concat(F.when(F.col("key") == F.col("first"), "").otherwise(","), "json").alias("json"))
        lines = lines.union(own).union(mark(place + 1, tail))
    lines.orderBy("part", "key").select("json").write.text(to)
    return to


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """(part, json): the lines of a written graph, entities and edges told apart by their key; in any order."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("json")).where("startswith(json, '{') AND json <> '{\"edges\":['")
    return lines.select(F.when(F.get_json_object("json", "$.edge_key").isNotNull(), "edge").otherwise("entity").alias("part"), "json")


def same_graph(a: CodeGraph, b: CodeGraph) -> bool:
    """Whether two graphs have the same canonical JSON, rows counted as often as they stand."""
    for x, y, key in ((a.entities, b.entities, "stable_key"), (a.edges, b.edges, "edge_key")):
        if sorted(x.columns) != sorted(y.columns):
            return False
        side = json_rows(x, key).select("json", F.lit(1).alias("n")).union(json_rows(y, key).select("json", F.lit(-1).alias("n")))
        if not side.groupBy("json").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty():
            return False
    return True
