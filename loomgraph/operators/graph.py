"""Adjacency, neighbourhoods, bounded traversal and summaries of a typed property multigraph.

A graph is two DataFrames: entities (stable_key, kind, ...) and edges (edge_key, source, target, edge_type, confidence, ...).
Parallel edges are occurrences and count as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import materialize, release

from .components import components


@dataclass(frozen=True)
class CodeGraph:
    entities: DataFrame
    edges: DataFrame

    def of_types(self, *edge_types: str) -> CodeGraph:
        return CodeGraph(self.entities, self.edges.where(F.col("edge_type").isin(*edge_types)))

    def entity(self, key: str) -> DataFrame:
        return self.entities.where(F.col("stable_key") == key)

    def scan(self) -> tuple[DataFrame, DataFrame]:
        """Entities and edges, each in the order of its key."""
        return self.entities.orderBy("stable_key"), self.edges.orderBy("edge_key")

    def select_one(self, file_path: str | None, kind: str, qualified_name: str):
        """The one entity with these values; LookupError where none or several have them."""
        rows = self.entities.where(F.col("file_path").eqNullSafe(F.lit(file_path)) & (F.col("kind") == kind) & (F.col("qualified_name") == qualified_name)).limit(2).collect()
        if len(rows) != 1:
            raise LookupError(f"{kind} {file_path or 'external'} {qualified_name} matched {'no entity' if not rows else 'several entities'}")
        return rows[0]

    def exports_of(self, files: DataFrame) -> DataFrame:
        """(file_path, stable_key, name): exported entities at the top level of each file of ``files`` (file_path)."""
        top = self.entities.where(F.col("exported") & ~F.contains("qualified_name", F.lit(".")))
        return top.join(files.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "stable_key", "name")

    def outgoing(self, key: str, *edge_types: str) -> DataFrame:
        """Edges from one entity; the filters reach the scans."""
        e = self.edges.where(F.col("source") == key)
        return e.where(F.col("edge_type").isin(*edge_types)) if edge_types else e

    def incoming(self, key: str, *edge_types: str) -> DataFrame:
        e = self.edges.where(F.col("target") == key)
        return e.where(F.col("edge_type").isin(*edge_types)) if edge_types else e

    def neighborhood(self, key: str) -> DataFrame:
        """(neighbor, edges): entities one hop away in either direction, with occurrences."""
        both = self.outgoing(key).select(F.col("target").alias("neighbor")).union(self.incoming(key).select(F.col("source").alias("neighbor")))
        return both.groupBy("neighbor").agg(F.count(F.lit(1)).alias("edges"))

    def degrees(self) -> DataFrame:
        """Occurrence-counted degrees and unique neighbours of every entity; a self-loop adds 2 and is its own neighbour."""
        # parallel edges are combined first, then each pair is seen from both ends: the explode is over pairs, not occurrences
        occurrences = self.edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
        zero = F.lit(0).cast("long")
        sides = F.explode(F.array(F.struct(F.col("source").alias("k"), F.col("target").alias("other"), F.col("n").alias("o"), zero.alias("i")), F.struct(F.col("target").alias("k"), F.col("source").alias("other"), zero.alias("o"), F.col("n").alias("i"))))
        pairs = occurrences.select(sides.alias("s")).groupBy("s.k", "s.other").agg(F.sum("s.o").alias("o"), F.sum("s.i").alias("i"))
        d = pairs.groupBy("k").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("unique_neighbors"))
        joined = self.entities.select("stable_key", "kind").join(d, F.col("stable_key") == F.col("k"), "left").drop("k")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        joined = joined.withColumns({c: zero(c) for c in ("in_degree", "out_degree", "unique_neighbors")})
        return joined.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def top_connected(self, k: int = 10) -> DataFrame:
        if k < 0:
            raise ValueError("k is a non-negative integer")
        return self.degrees().orderBy(F.desc("degree"), F.desc("unique_neighbors"), "stable_key").limit(k)

    def isolated(self) -> DataFrame:
        """Entities without a neighbour."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("k"))
        return self.entities.join(ends, F.col("stable_key") == F.col("k"), "left_anti")

    def component_of(self) -> DataFrame:
        """(stable_key, component): least key that an entity reaches, directions ignored."""
        found = components(self.edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
        joined = self.entities.select("stable_key").join(found, F.col("stable_key") == F.col("node"), "left")
        return joined.select("stable_key", F.coalesce("component", "stable_key").alias("component"))

    def forward(self, starts: DataFrame, max_depth: int, *edge_types: str) -> DataFrame:
        return traverse(self, starts, max_depth, edge_types, False)

    def reverse(self, starts: DataFrame, max_depth: int, *edge_types: str) -> DataFrame:
        return traverse(self, starts, max_depth, edge_types, True)


def traverse(graph: CodeGraph, starts: DataFrame, max_depth: int, edge_types: tuple = (), backward: bool = False) -> DataFrame:
    """(start, entity, depth, path) of a breadth-first walk from each start; starts (start) aren't returned.

    An entity is reached once, by the least path of edge keys among its shortest ones, as a queue that follows edges in key order
    would.  Each level is one join of the frontier with the edges, an anti join with what was seen, and a minimum; levels are
    written, so plans don't grow with the depth.
    """
    if max_depth < 0:
        raise ValueError("max_depth is a non-negative integer")
    edges = graph.edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else graph.edges
    here, there = ("target", "source") if backward else ("source", "target")
    # every level joins the same steps: what leads to them is worked out once
    step = materialize(edges.select(F.col(here).alias("entity"), F.col(there).alias("next"), "edge_key"), "steps")
    frontier = starts.select("start", F.col("start").alias("entity"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"))
    seen = frontier
    for depth in range(1, max_depth + 1):
        grown = frontier.join(step, "entity").select("start", F.col("next").alias("entity"), F.concat("path", F.array("edge_key")).alias("path"))
        fresh = grown.join(seen.select("start", "entity"), ["start", "entity"], "left_anti")
        frontier = materialize(fresh.groupBy("start", "entity").agg(F.min("path").alias("path")).select("start", "entity", F.lit(depth).alias("depth"), "path"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def transitive(pairs: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Transitive closure of (a, b) by squaring; semi-naive rounds are written and stop when nothing is new."""
    known = materialize(pairs.select("a", "b").distinct(), "closure")
    fresh = known
    for _ in range(max_rounds):
        longer = fresh.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        back = known.select("a", F.col("b").alias("m")).join(fresh.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        fresh = materialize(longer.union(back).distinct().join(known, ["a", "b"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.union(fresh)
    raise RuntimeError("the closure didn't settle")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges (source, target) that lie on a cycle: both ends in one strongly connected component, self-loops included."""
    inside = strong_components(edges)
    s, t = (inside.select(F.col("node").alias(k), F.col("component").alias("c_" + k)) for k in ("source", "target"))
    pairs = edges.select("source", "target").distinct()
    return pairs.where("source = target").union(pairs.where("source <> target").join(s, "source").join(t, "target").where("c_source = c_target").select("source", "target"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle of two nodes or more; component is a node of it.

    Forward-backward colouring: nodes without an incoming or outgoing edge are peeled off, every node takes the greatest node that
    reaches it, and of a colour those that also reach that node backwards are one component; the others go again.  Rounds and their
    levels end when nothing changes, and only the latest tables are kept.
    """
    left = materialize(edges.select("source", "target").where("source <> target").distinct(), "scc")
    found = None
    while True:
        left = _peeled(left)
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")))
        own = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("ct")), "target")
        same = materialize(own.where("cs = ct").select("source", "target", F.col("cs").alias("colour")), "scc")
        back = materialize(same.select(F.col("colour").alias("node"), "colour").distinct(), "scc")
        fresh = back
        while not fresh.isEmpty():
            step = same.join(fresh.select(F.col("node").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("node"), "colour").distinct()
            fresh = materialize(step.join(back, ["node", "colour"], "left_anti"), "scc")
            back = back.union(fresh)
        part = materialize(back.select("node", F.col("colour").alias("component")), "scc")
        found = part if found is None else found.union(part)
        gone = part.select("node")
        rest = left.join(gone, F.col("source") == F.col("node"), "left_anti").join(gone, F.col("target") == F.col("node"), "left_anti")
        after = materialize(rest, "scc")
        release(left, same)
        left = after
    if found is None:
        kind = edges.schema["source"].dataType
        return edges.sparkSession.createDataFrame([], "node string, component string").select(F.col("node").cast(kind), F.col("component").cast(kind))
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return found.join(size, "component", "left_semi").select("node", "component")


def _peeled(left: DataFrame) -> DataFrame:
    """Without edges at nodes that lack an incoming or an outgoing one; two levels a round at least, until few of them go."""
    n = left.count()
    while n:
        sources, targets = left.select(F.col("source").alias("k")).distinct(), left.select(F.col("target").alias("k")).distinct()
        after = materialize(left.join(targets, F.col("source") == F.col("k"), "left_semi").join(sources, F.col("target") == F.col("k"), "left_semi"), "scc")
        release(left)
        left, m = after, after.count()
        if m == n:
            break
        n = m
    return left


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Each node's greatest colour among those that reach it; a level at a time, only from nodes that changed."""
    known = materialize(colour, "scc")
    fresh = known
    while not fresh.isEmpty():
        sent = edges.join(fresh.select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("sent"))
        fresh_after = materialize(known.join(sent, "node").where("sent > colour").select("node", F.col("sent").alias("colour")), "scc")
        after = materialize(known.join(fresh_after.select("node", F.col("colour").alias("new")), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")), "scc")
        release(known, None if fresh is known else fresh)
        known, fresh = after, fresh_after
    return known
