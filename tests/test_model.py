"""Values, constraints, scans, graph JSON and resolution, against hand-written expectations."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import values as fv
from loomgraph.operators import compare, resolve, validate
from loomgraph.operators.graph import CodeGraph, cycle_edges, strong_components
from loomgraph.sources import artifacts, graph_json


def column(spark, rows, *exprs, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(*exprs).collect()]


def test_domain_table_by_row(spark):
    kinds = {k: k for k in fv.ENTITY_KINDS}
    ents = spark.createDataFrame([(k, k) for k in kinds] + [("t:" + k, k) for k in kinds], "stable_key string, kind string")
    cases = [("DEPENDS_ON", "MODULE", "FILE", True), ("DEPENDS_ON", "FILE", "MODULE", False), ("CONTAINS", "ENUM", "VARIABLE", True), ("CONTAINS", "FUNCTION", "CLASS", False), ("CONTAINS", "FILE", "REPOSITORY", False), ("IMPORTS", "FILE", "UNRESOLVED", True), ("IMPORTS", "CLASS", "FILE", False), ("EXPORTS", "MODULE", "CLASS", True), ("CALLS", "API_ROUTE", "METHOD", True), ("CALLS", "FILE", "CLASS", False), ("REFERENCES", "TEST", "ENUM", True), ("REFERENCES", "API_ROUTE", "ENUM", False), ("EXTENDS", "INTERFACE", "INTERFACE", True), ("EXTENDS", "CLASS", "INTERFACE", False), ("IMPLEMENTS", "CLASS", "INTERFACE", True), ("INSTANTIATES", "VARIABLE", "CLASS", True), ("ROUTES_TO", "API_ROUTE", "FUNCTION", True), ("TESTS", "TEST", "UNRESOLVED", False), ("TESTS", "TEST", "CLASS", True), ("POSSIBLE_CALL", "FILE", "COMPONENT", True), ("POSSIBLE_CALL", "API_ROUTE", "COMPONENT", False)]
    edges = spark.createDataFrame([(str(i), s, "t:" + t, e) for i, (e, s, t, _) in enumerate(cases)], "edge_key string, source string, target string, edge_type string")
    bad = {r.edge_key for r in validate.domain_violations(CodeGraph(ents, edges)).collect()}
    assert bad == {str(i) for i, c in enumerate(cases) if not c[3]}


def test_canonical_json(spark):
    odd = ['a"b\\c', "line\nend\ttab\r\x08\x0c", "\x01\x1f", "é漢🙂", "", None]
    got = column(spark, odd, fv.json_string(F.col("x")))
    want = [json.dumps(x, ensure_ascii=False) for x in odd]
    assert [g for (g,) in got] == want
    rows = spark.createDataFrame([(None, "A", "B"), ("A", None, "B"), ("A", "B", None)], "a string, b string, c string")
    assert len({r.k for r in rows.select(fv.named_identity(F.col("a"), F.col("b"), F.col("c")).alias("k")).collect()}) == 3


def test_packages(spark):
    specs = {"lodash": ("NPM", "lodash", None), "lodash/fp/x": ("NPM", "lodash", "fp/x"), "@s/p/q": ("NPM", "@s/p", "q"), "@s": None, "@/p": None, "lodash//x": None, "a/../b": None, "./x": None, "/x": None, "#x": None, "a\\b": None, "https://h/x": None, "": None, "async_hooks": ("NODE_BUILTIN", "node:async_hooks", None), "node:fs/promises": ("NODE_BUILTIN", "node:fs", "promises"), "inspector": ("NODE_BUILTIN", "node:inspector", None), "fs/promises": ("NODE_BUILTIN", "node:fs", "promises"), "node:test": ("NODE_BUILTIN", "node:test", None), "test": ("NPM", "test", None)}
    got = column(spark, list(specs), "x", fv.package_reference(F.col("x")).alias("r"))
    assert {x: tuple(r) if r else None for x, r in got} == specs


def test_names_and_paths(spark):
    assert column(spark, ["a/b/c.ts", "c.ts"], fv.base_name(F.col("x")), fv.directory_name(F.col("x"))) == [("c.ts", "a/b"), ("c.ts", ".")]
    assert column(spark, ["Ab1", "ab", "A_b", "A"], fv.pascal_case(F.col("x"))) == [(True,), (False,), (False,), (True,)]
    assert column(spark, ["  x\n", " ", None], fv.trimmed(F.col("x"))) == [("x",), (None,), (None,)]
    assert column(spark, [("/r/", "/r/a//b"), ("/r", "/rx/a"), ("C:\\r", "C:\\r\\a")], fv.repository_relative(F.col("r"), F.col("p")), schema="r string, p string") == [("a/b",), (None,), ("a",)]
    assert column(spark, ["e\u0301\r\nx\ry"], fv.local_fingerprint(F.col("x"))) == [("lf:v1:sha256:" + hashlib.sha256("é\nx\ny".encode()).hexdigest(),)]


def test_diagnostics(spark):
    ents = spark.createDataFrame([("a", "CLASS", "A"), ("b", "FUNCTION", "B"), ("c", "CLASS", " "), ("b", "METHOD", "B")], "stable_key string, kind string, name string")
    rows = [("1", "a", "b", "CALLS", 1.0, "f", 3), ("2", "a", "b", "REFERENCES", 1.0, "f", 3), ("3", "a", "b", "REFERENCES", 1.0, "f", 4), ("4", "a", "zz", "CALLS", 1.0, "f", 5), ("5", "a", "b", "CALLS", 1.5, "f", 6)]
    edges = spark.createDataFrame(rows, "edge_key string, source string, target string, edge_type string, confidence double, file_path string, start_line int")
    got = {(r.code, r.subject) for r in validate.diagnostics(CodeGraph(ents, edges)).collect()}
    assert {("INVALID_ENTITY", "c"), ("CALL_REFERENCE_DUPLICATION", "2"), ("INVALID_EDGE", "4"), ("INVALID_EDGE", "5"), ("CONFLICTING_ENTITY", "b")} <= got
    assert not {("CALL_REFERENCE_DUPLICATION", "3"), ("INVALID_EDGE", "1")} & got


def test_cycles_alone(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "x"), ("g", "h")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    assert {(r.source, r.target) for r in cycle_edges(edges).collect()} == {("a", "b"), ("b", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "x")}
    groups = {}
    for r in strong_components(edges).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["d", "e", "f"]]
    assert cycle_edges(edges.limit(0)).count() == 0


def test_scan(spark, tmp_path):
    root = tmp_path / "src" / "repo" / "src"
    files = {"a.ts": b"x", "b/c.tsx": b"x", "dist/d.js": b"x", "generated/e.js": b"x", "Tests/Baselines/f.ts": b"x", "g.min.js": b"x", "h.js": b"a\x00b", "package.json": b"{}", "tsconfig.base.json": b"{}", "other.json": b"{}", "x.yaml": b"", "pnpm-workspace.yaml": b"a:", "empty.ts": b"", "big.ts": b"y" * 60, ".HG/z.ts": b"x", "long.js": ("é" * 100_001).encode()}
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    got = {r.path: (r.role, r.format, r.skip) for r in artifacts.scan(spark, str(root), max_bytes=50).collect()}
    assert got == {"a.ts": ("SOURCE", "TYPESCRIPT", None), "b/c.tsx": ("SOURCE", "TYPESCRIPT_JSX", None), "generated/e.js": ("SOURCE", "JAVASCRIPT", None), "g.min.js": ("SOURCE", "JAVASCRIPT", "GENERATED_SOURCE_SKIPPED"), "h.js": ("SOURCE", "JAVASCRIPT", "BINARY_SOURCE_SKIPPED"), "package.json": ("PROJECT_CONFIGURATION", "JSON", None), "tsconfig.base.json": ("PROJECT_CONFIGURATION", "JSON", None), "pnpm-workspace.yaml": ("PROJECT_CONFIGURATION", "YAML", None), "big.ts": ("SOURCE", "TYPESCRIPT", "FILE_TOO_LARGE"), "long.js": ("SOURCE", "JAVASCRIPT", "FILE_TOO_LARGE")}
    few = {r.path: r.skip for r in artifacts.scan(spark, str(root), max_files=2).where("role = 'SOURCE'").collect()}
    assert few["a.ts"] is None and few["b/c.tsx"] is None and few["h.js"] == "MAX_FILES_EXCEEDED" and few["generated/e.js"] == "MAX_FILES_EXCEEDED"
    assert {r.path: r.skip for r in artifacts.scan(spark, str(root)).collect()}["long.js"] == "GENERATED_SOURCE_SKIPPED"


def test_graph_json(spark, tmp_path):
    ents = spark.createDataFrame([("b", "CLASS", None, True), ("a", "FILE", 'q"', False)], "stable_key string, kind string, name string, exported boolean")
    edges = spark.createDataFrame([("e1", "a", "b", "CONTAINS", 1.0, None)], "edge_key string, source string, target string, edge_type string, confidence double, line int")
    g = CodeGraph(ents, edges)
    path = graph_json.write_graph_json(g, str(tmp_path / "g"))
    text = "".join(line.value for line in spark.read.text(path).coalesce(1).collect())
    document = json.loads("".join(x for f in sorted((tmp_path / "g").glob("part-*")) for x in f.read_text().splitlines()))
    assert text and [e["stable_key"] for e in document["entities"]] == ["a", "b"] and document["schemaVersion"] == 1
    assert document["entities"][1]["name"] is None and document["edges"][0]["line"] is None
    assert sorted(r.part for r in graph_json.read_graph_json(spark, path).collect()) == ["edge", "entity", "entity"]
    assert graph_json.same_graph(g, CodeGraph(ents.orderBy("stable_key"), edges))
    assert not graph_json.same_graph(g, CodeGraph(ents.union(ents.limit(1)), edges))
    empty = graph_json.write_graph_json(CodeGraph(ents.limit(0), edges.limit(0)), str(tmp_path / "none"))
    assert json.loads("".join(x for f in sorted((tmp_path / "none").glob("part-*")) for x in f.read_text().splitlines())) == {"edges": [], "entities": [], "schemaVersion": 1} and empty


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.tsx", "src/c.mts", "pk/src/index.ts", "pk/src/deep/x.ts", "pk/lib.ts")], "path string")
    packages = spark.createDataFrame([("@w/pk", "pk", "./dist/index.js"), ("esc", "pk", "./../src/a.ts")], "name string, root string, entry string")
    asked = {"./b": ("FILE", "src/b/index.tsx", None), "./c.mjs": ("FILE", "src/c.mts", None), "./none": ("UNRESOLVED", None, "OUTSIDE_ANALYSIS_SCOPE"), "../../x": ("UNRESOLVED", None, "OUTSIDE_ANALYSIS_SCOPE"), "@w/pk": ("FILE", "pk/src/index.ts", None), "@w/pk/build/deep/x.js": ("FILE", "pk/src/deep/x.ts", None), "@w/pkg": ("EXTERNAL_PACKAGE", "@w/pkg", None), "esc": ("UNRESOLVED", None, "OUTSIDE_ANALYSIS_SCOPE"), "fs": ("EXTERNAL_PACKAGE", "node:fs", None), "#in": ("UNRESOLVED", None, "UNSUPPORTED_SYNTAX"), "../pk/lib": ("FILE", "pk/lib.ts", None)}
    got = resolve.resolve_imports(spark.createDataFrame([("src/a.ts", s) for s in asked], "file_path string, specifier string"), files, packages)
    assert {r.specifier: (r.kind, r.target, r.reason) for r in got.collect()} == asked


def test_star_exports(spark):
    own = spark.createDataFrame([("a", "x"), ("c", "y")], "file string, entity string")
    stars = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("d", "t")], "file string, target string")
    top = spark.createDataFrame([("t", "z"), ("a", "w")], "file string, entity string")
    got = {(r.file, r.entity) for r in resolve.star_exports(own, stars, top).collect()}
    assert got == {("a", "x"), ("c", "y"), ("b", "x"), ("c", "x"), ("b", "y"), ("d", "z")}


def test_comparison_by_evidence_and_facts(spark):
    ents = spark.createDataFrame([("a", "CLASS", "f", "A"), ("b", "FUNCTION", "f", "B"), ("b2", "FUNCTION", "f", "B")], "stable_key string, kind string, file_path string, qualified_name string")
    schema = "edge_key string, source string, target string, edge_type string, confidence double, file_path string, start_line int, start_column int, end_line int, end_column int"
    one = spark.createDataFrame([("1", "a", "b", "CALLS", 0.9, "f", 1, 1, 1, 5)], schema)
    two = spark.createDataFrame([("1", "a", "b", "CALLS", 0.8, "f", 2, 1, 2, 5)], schema)
    f1 = lambda **k: {r.part: r.f1 for r in compare.graph_comparison(CodeGraph(ents, one), CodeGraph(ents, two), **k).collect()}["edges"]
    assert f1() == 1.0 and f1(evidence=True) == 0.0 and f1(minimum=True) == 0.0
    assert compare.is_perfect(compare.graph_comparison(CodeGraph(ents, one), CodeGraph(ents, one))).first().perfect
    unresolved = spark.createDataFrame([("a", "CALLS", "o.m", "DYNAMIC_DISPATCH"), (None, "IMPORTS", None, "R")], "source string, edge_type string, target_text string, reason string")
    fact = lambda i, kind, s=None, t=None, edge=None, text=None, reason=None: (i, kind, "f" if s else None, s and s[0], s and s[1], "f" if t else None, t and t[0], t and t[1], edge, 0.85, text, reason)
    a, b, two_b = ("CLASS", "A"), ("FUNCTION", "B"), ("FUNCTION", "B")
    rows = [fact("1", "ENTITY", a), fact("2", "ENTITY", two_b), fact("3", "EDGE", a, b, "CALLS"), fact("4", "UNRESOLVED", a, None, "CALLS", "o.m", "DYNAMIC_DISPATCH"), fact("5", "UNRESOLVED", None, None, "IMPORTS", None, "R"), fact("6", "UNRESOLVED", None, None, "CALLS", "o.m", "DYNAMIC_DISPATCH"), fact("7", "ODD", a)]
    facts = spark.createDataFrame(rows, "id string, kind string, source_path string, source_kind string, source_name string, target_path string, target_kind string, target_name string, edge_type string, minimum_confidence double, target_text string, reason string")
    got = {r.id: r.passed for r in compare.fact_results(CodeGraph(ents, one), unresolved, facts).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": True, "5": True, "6": False, "7": False}
    alone = CodeGraph(ents.where("stable_key <> 'b2'"), one)
    assert {r.id: r.passed for r in compare.fact_results(alone, unresolved, facts).collect()}["3"]
    with pytest.raises(LookupError):
        CodeGraph(ents, one).select_one("f", "FUNCTION", "B")
    assert CodeGraph(ents, one).select_one("f", "CLASS", "A").stable_key == "a"


def test_ranks_within_groups(spark):
    rows = spark.createDataFrame([(g, i, (i * 37) % 11) for g in ("a", "b", None) for i in range(200)], "channel string, item int, score int")
    got = {(r.channel, r.item): r["rank"] for r in compare.ranked(rows, "channel", F.desc("score"), F.col("item")).collect()}
    order = sorted(range(200), key=lambda i: (-((i * 37) % 11), i))
    assert got == {(g, i): k + 1 for g in ("a", "b", None) for k, i in enumerate(order)}


def test_workers_keep_only_what_tasks_ask_for():
    from loomgraph.sources import ship

    made = []

    def task(names):
        def work(batches):
            for b in batches:
                for n in names:
                    ship.kept(n, lambda: made.append(n))
                yield b

        return list(ship._released(work)([1, 2]))

    ship._kept.clear()
    assert task("ab") == [1, 2] and made == ["a", "b"]
    task("b")
    assert made == ["a", "b"] and set(ship._kept) == {"b"}
    task("")
    assert not ship._kept
