"""Hand-made graphs for what the given tables lack."""

import random

import pytest

from loomgraph.operators import compare, lifecycle, validate
from loomgraph.operators.components import components
from loomgraph.operators.graph import CodeGraph, cycle_edges, traverse

EDGE = "edge_key string, source string, target string, edge_type string, confidence double"


def graph(spark, entities, edges):
    e = spark.createDataFrame([(k, kind, k) for k, kind in entities], "stable_key string, kind string, name string")
    return CodeGraph(e, spark.createDataFrame([(f"e{i:03}", *x) for i, x in enumerate(edges)], EDGE))


def test_self_loop_counts_twice_and_is_its_own_neighbour(spark):
    g = graph(spark, [("a", "CLASS"), ("b", "CLASS")], [("a", "a", "REFERENCES", 1.0)])
    got = {r.stable_key: (r.degree, r.unique_neighbors) for r in g.degrees().collect()}
    assert got == {"a": (2, 1), "b": (0, 0)}
    assert [r.stable_key for r in g.isolated().collect()] == ["b"]


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert g.component_of().count() == 0 and g.top_connected(0).count() == 0
    assert validate.diagnostics(g).count() == 0


def test_cycle_and_tail(spark):
    g = graph(spark, [], [("a", "b", "CONTAINS", 1.0), ("b", "a", "CONTAINS", 1.0), ("b", "c", "CONTAINS", 1.0)])
    assert {(r.source, r.target) for r in cycle_edges(g.edges).collect()} == {("a", "b"), ("b", "a")}


def test_traversal_takes_the_queue_order(spark):
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(rng.choice(nodes), rng.choice(nodes), "CALLS", 1.0) for _ in range(25)]
    g = graph(spark, [(n, "FUNCTION") for n in nodes], edges)
    out = {}
    for i, (s, t, *_) in enumerate(edges):
        out.setdefault(s, []).append((f"e{i:03}", t))
    queue, seen, want = [("n0", 0, [])], {"n0"}, {}
    while queue:
        at, depth, path = queue.pop(0)
        if depth == 3:
            continue
        for key, to in sorted(out.get(at, [])):
            if to not in seen:
                seen.add(to)
                want[to] = (depth + 1, path + [key])
                queue.append((to, depth + 1, path + [key]))
    got = traverse(g, spark.createDataFrame([("n0",)], "start string"), 3)
    assert {r.entity: (r.depth, list(r.path)) for r in got.collect()} == want
    with pytest.raises(ValueError):
        traverse(g, spark.createDataFrame([("n0",)], "start string"), -1)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}


def test_metrics_of_empty_sets(spark):
    empty = spark.createDataFrame([], "k string")
    one = spark.createDataFrame([("a",)], "k string")
    m = lambda e, a: compare.metrics(compare.counts(e, a, ["k"])).select("precision", "recall", "f1").first()
    assert tuple(m(empty, empty)) == (1.0, 1.0, 1.0)
    assert tuple(m(one, empty)) == (0.0, 0.0, 0.0)
    assert tuple(m(empty, one)) == (0.0, 1.0, 0.0)


def test_large_commits_are_left_out(spark):
    rows = [(1, i) for i in range(51)] + [(2, 1), (2, 2)]
    got = compare.cochange(spark.createDataFrame(rows, "commit long, file long")).collect()
    assert [(r.a, r.b, r.support) for r in got] == [(1, 2, 1)]


def test_pin_that_ends_now_is_not_active(spark):
    ready = spark.createDataFrame([(1, i, f"2020-01-0{i} 00:00:00") for i in range(1, 8)], "repository long, snapshot_id long, ready_at string").selectExpr("repository", "snapshot_id", "timestamp(ready_at) AS ready_at")
    pins = spark.createDataFrame([(1, "2021-01-01 00:00:00"), (2, "2021-01-01 00:00:01")], "snapshot_id long, t string").selectExpr("snapshot_id", "timestamp(t) AS expires_at")
    from pyspark.sql import functions as F

    gone = lifecycle.retention(ready, pins, spark.createDataFrame([(7,)], "snapshot_id long"), F.lit("2021-01-01").cast("timestamp"))
    assert [r.snapshot_id for r in gone.collect()] == [1]


def test_store_round_trip(spark, tmp_path):
    from loomgraph.sources.store import SnapshotStore

    store = SnapshotStore(spark, str(tmp_path / "s"))
    g = graph(spark, [("a", "CLASS"), ("b", "CLASS")], [("a", "b", "REFERENCES", 0.5)])
    store.publish("r", "one", g)
    store.publish("r", "one", g)
    back = store.load("one")
    assert (back.entities.count(), back.edges.count()) == (2, 1)
    with pytest.raises(LookupError):
        store.load("two")


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions import values as fv

    rows = spark.createDataFrame([("a//./b\\c", "@s/p/q", "x\n"), ("../a", "./x", ""), ("C:/x", "fs", "a\r\nb"), (None, None, None)], "p string, s string, t string")
    got = rows.select(fv.normalized_path(F.col("p")).alias("p"), fv.path_problem(F.col("p")).alias("w"), fv.external_package(F.col("s")).alias("s"), fv.line_count(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("a/b/c", None, "@s/p", 2), (None, "PARENT", None, 0), (None, "ABSOLUTE", "node:fs", 2), (None, "NULL", None, None)]
