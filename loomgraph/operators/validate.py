"""Constraint queries: every check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.values import EDGE_TYPES, ENTITY_KINDS, valid_confidence

from .graph import CodeGraph, cycle_edges

_OWNER = ("MODULE", "FILE", "FUNCTION", "METHOD", "CONSTRUCTOR", "CLASS", "VARIABLE", "COMPONENT", "TEST")
_CALLABLE = ("FUNCTION", "METHOD", "CONSTRUCTOR", "COMPONENT")
_ANY = tuple(k for k in ENTITY_KINDS if k != "REPOSITORY")
#: Which kinds an edge type may join, as (sources, targets) pairs.
DOMAINS = {
    "CONTAINS": [(("REPOSITORY", "MODULE", "FILE", "CLASS", "INTERFACE", "ENUM"), _ANY)],
    "IMPORTS": [(("MODULE", "FILE"), ("MODULE", "FILE", "EXTERNAL_PACKAGE", "UNRESOLVED"))],
    "EXPORTS": [(("MODULE", "FILE"), _ANY)],
    "CALLS": [((*_OWNER, "API_ROUTE"), _CALLABLE)],
    "REFERENCES": [(_OWNER, _ANY)],
    "EXTENDS": [(("CLASS",), ("CLASS",)), (("INTERFACE",), ("INTERFACE",))],
    "IMPLEMENTS": [(("CLASS",), ("INTERFACE",))],
    "INSTANTIATES": [(_OWNER, ("CLASS",))],
    "ROUTES_TO": [(("API_ROUTE",), _CALLABLE)],
    "TESTS": [(("TEST",), tuple(k for k in _ANY if k != "UNRESOLVED"))],
    "DEPENDS_ON": [(("MODULE", "EXTERNAL_PACKAGE"), ("MODULE", "FILE", "EXTERNAL_PACKAGE", "UNRESOLVED"))],
    "POSSIBLE_CALL": [(_OWNER, _CALLABLE)],
}
NO_SELF = ("CONTAINS", "EXTENDS", "IMPLEMENTS", "INSTANTIATES")


def domain_violations(graph: CodeGraph) -> DataFrame:
    """Edges whose kinds the domain table doesn't allow, or that join an entity to itself where that isn't allowed."""
    kinds = graph.entities.select("stable_key", "kind")
    s = kinds.select(F.col("stable_key").alias("source"), F.col("kind").alias("source_kind"))
    t = kinds.select(F.col("stable_key").alias("target"), F.col("kind").alias("target_kind"))
    ok = F.lit(False)
    for kind, rules in DOMAINS.items():
        for a, b in rules:
            ok = ok | ((F.col("edge_type") == kind) & F.col("source_kind").isin(*a) & F.col("target_kind").isin(*b))
    self_edge = (F.col("source") == F.col("target")) & F.col("edge_type").isin(*NO_SELF)
    return graph.edges.join(s, "source").join(t, "target").where(~ok | self_edge)


def missing_endpoints(graph: CodeGraph) -> DataFrame:
    """(edge_key, side, endpoint) of ends that no entity has."""
    ends = graph.edges.select("edge_key", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("endpoint")), F.struct(F.lit("target").alias("side"), F.col("target").alias("endpoint")))).alias("e")).select("edge_key", "e.side", "e.endpoint")
    return ends.join(graph.entities.select(F.col("stable_key").alias("endpoint")), "endpoint", "left_anti")


def duplicate_conflicts(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with different values, with the number of rows and of distinct values."""
    value = F.struct(*values)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values")).where("n_values > 1")


def occurrence_overlaps(edges: DataFrame, evidence: list[str]) -> DataFrame:
    """REFERENCES edges that repeat a CALLS occurrence (source, target, evidence; null-safe)."""
    calls = edges.where("edge_type = 'CALLS'").select(*[F.col(c).alias(f"__{c}") for c in ("source", "target", *evidence)])
    cond = (F.col("source") == F.col("__source")) & (F.col("target") == F.col("__target"))
    for c in evidence:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return edges.where("edge_type = 'REFERENCES'").join(calls, cond, "left_semi")


def invalid_entities(entities: DataFrame) -> DataFrame:
    """Entities that break an invariant of their own: a blank name, an unknown kind, a key that isn't one, a default export that isn't
    exported, a source range of another file or without order.  Columns that ``entities`` lacks aren't looked at."""
    has = set(entities.columns)
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    bad = blank("name") | ~F.col("kind").isin(*ENTITY_KINDS) | F.col("stable_key").isNull()
    if "qualified_name" in has:
        bad = bad | blank("qualified_name")
    if {"exported", "default_export"} <= has:
        bad = bad | (F.coalesce("default_export", F.lit(False)) & ~F.coalesce("exported", F.lit(False)))
    if "declaration_fingerprint" in has:
        bad = bad | ~F.coalesce(F.col("declaration_fingerprint").startswith("df:v1:sha256:"), F.lit(True))
    if "implementation_fingerprint" in has:
        bad = bad | ~F.coalesce(F.col("implementation_fingerprint").startswith("if:v1:sha256:"), F.lit(True))
    if {"start_line", "start_column", "end_line", "end_column"} <= has:
        bad = bad | _bad_range()
    return entities.where(F.coalesce(bad, F.lit(True)))


def _bad_range():
    ends = [F.col(c) for c in ("start_line", "start_column", "end_line", "end_column")]
    some, all_ = ends[0].isNotNull(), ends[0].isNull()
    for e in ends[1:]:
        some, all_ = some | e.isNotNull(), all_ | e.isNull()
    low = (ends[0] < 1) | (ends[1] < 1) | (F.struct(ends[2], ends[3]) < F.struct(ends[0], ends[1]))
    return some & (all_ | low)


def invalid_edges(edges: DataFrame) -> DataFrame:
    """Edges that break an invariant of their own: an unknown type, a confidence outside 0 to 1, a missing end, a bad range."""
    bad = ~valid_confidence(F.col("confidence")) | ~F.col("edge_type").isin(*EDGE_TYPES) | F.col("source").isNull() | F.col("target").isNull()
    if {"start_line", "start_column", "end_line", "end_column"} <= set(edges.columns):
        bad = bad | _bad_range()
    return edges.where(F.coalesce(bad, F.lit(True)))


def evidence_beyond_file(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose evidence names a file that ``files`` (path, n_lines) lacks, or a line beyond its end."""
    f = files.select(F.col("path").alias("file_path"), "n_lines")
    return edges.where("file_path IS NOT NULL").join(f, "file_path", "left").where("n_lines IS NULL OR coalesce(end_line, start_line) > n_lines")


def diagnostics(graph: CodeGraph) -> DataFrame:
    """(code, subject) of all checks, the two insert-time ones included."""
    row = lambda df, code, col: df.select(F.lit(code).alias("code"), F.col(col).alias("subject"))
    out = row(invalid_entities(graph.entities), "INVALID_ENTITY", "stable_key")
    for df in (invalid_edges(graph.edges), domain_violations(graph), missing_endpoints(graph)):
        out = out.union(row(df, "INVALID_EDGE", "edge_key"))
    cycles = cycle_edges(graph.edges.where("edge_type = 'CONTAINS'"))
    out = out.union(row(cycles, "CONTAINMENT_CYCLE", "source"))
    evidence = [c for c in ("file_path", "start_line", "start_column", "end_line", "end_column") if c in graph.edges.columns]
    if evidence:
        out = out.union(row(occurrence_overlaps(graph.edges, evidence), "CALL_REFERENCE_DUPLICATION", "edge_key"))
    values = [c for c in graph.entities.columns if c != "stable_key"]
    out = out.union(row(duplicate_conflicts(graph.entities, ["stable_key"], values), "CONFLICTING_ENTITY", "stable_key"))
    values = [c for c in graph.edges.columns if c != "edge_key"]
    return out.union(row(duplicate_conflicts(graph.edges, ["edge_key"], values), "CONFLICTING_EDGE", "edge_key")).distinct()
