"""Queries on tables whose groups are larger than those of the given ones."""

import shutil
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from loomgraph.operators import resolve, retrieval
from loomgraph.plans.queries import ORACLES, QUERIES
from tests.oracle import actual, expected

SF = "/root/testdata/sf0.001"


def matches_sql(spark, name, folder, **tables):
    """Whether a query gives its SQL's rows on the tables of SF with ``tables`` in the place of theirs."""
    shutil.copytree(SF, folder, dirs_exist_ok=True)
    for t, rows in tables.items():
        (folder / f"{t}.parquet").unlink()
        rows.write.parquet(str(folder / "made" / t))
        shutil.move(next((folder / "made" / t).glob("part-*.parquet")), folder / f"{t}.parquet")
    return actual(QUERIES[name](spark, str(folder))) == expected(ORACLES[name], str(folder))


def test_scan_takes_more_files_than_a_folder_scan(spark, tmp_path):
    pages = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>").alias("html"))
    assert matches_sql(spark, "scan_classification", tmp_path / "t", pages=pages)


def joined_rows(spark, df):
    """Rows of ``df``, and the most rows that a join made for one of the executions it took."""
    store = spark._jsparkSession.sharedState().statusStore()
    begin = store.executionsList().size()
    rows = df().collect()
    most = 0
    for i in range(begin, store.executionsList().size()):
        ident = store.executionsList().apply(i).executionId()
        metrics, nodes = store.executionMetrics(ident), store.planGraph(ident).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                    most = max(most, int(metrics.apply(m.accumulatorId()).replace(",", "")))
    return rows, most


def test_bindings_meet_each_export_once(spark):
    k = F.col("id")
    imports = spark.range(300).select(F.concat(F.lit("f"), k).alias("file_path"), F.lit("t").alias("target_file"), F.when(k == 7, "default").when(k != 8, "n").alias("imported"), F.lit("l").alias("local"))
    exports = spark.range(300).select(F.lit("t").alias("file"), F.when(k > 0, "n").otherwise("").alias("name"), F.when(k > 1, k > 5).alias("default_export"), F.format_string("e%03d", k).alias("entity"))
    rows, most = joined_rows(spark, lambda: resolve.bindings(imports, exports))
    assert {r.file_path: r.entity for r in rows} == {f"f{i}": "e006" if i == 7 else "e001" for i in range(300) if i != 8}
    assert 0 < most <= 300


def test_bindings_take_orders_of_every_customer(spark, tmp_path):
    made = {
        "orders": "(VALUES (1, 7), (2, 10), (3, NULL), (4, 19)) t(o_orderkey, o_custkey)",
        "lineitem": "(VALUES (1, 3, 1), (1, 3, 1), (2, 13, 5), (3, 3, 6), (4, 13, 6), (4, 4, 6)) t(l_orderkey, l_partkey, l_linenumber)",
        "part": "(VALUES (3, 5), (13, 6), (33, 6), (8, 6)) t(p_partkey, p_size)",
    }
    for given in Path(SF).glob("*.parquet"):  # links: the given folder is read only, and a copy of it would be too
        if given.stem not in made:
            (tmp_path / given.name).symlink_to(given)
    for t, rows in made.items():
        duckdb.sql(f"COPY (SELECT * FROM {rows}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    columns, rows = actual(QUERIES["import_bindings"](spark, str(tmp_path)))
    found = {tuple(r[columns.index(c)] for c in ("file_path", "local", "entity")) for r in rows}
    assert found == {("f7", "l3", "e3.5"), ("f10", "l13", "e3.5"), (None, "l3", "e13.6"), ("f19", "l13", "e13.6")} and len(rows) == 4
    assert (columns, rows) == expected(ORACLES["import_bindings"], str(tmp_path))


def test_trigrams_meet_by_rare_ones(spark):
    names = spark.range(400).select(F.col("id").alias("item"), F.format_string("Customer#%09d", F.col("id") % 200).alias("name"))
    names = names.union(spark.createDataFrame([(1000, "été 𝒳y"), (1001, "Été"), (1002, None), (1003, "été 𝒳yz")], "item long, name string"))
    queries = names.where("item % 100 < 4 OR item >= 1000").withColumnRenamed("item", "q")
    rows, most = joined_rows(spark, lambda: retrieval.trigram_search(names, queries, 0.75))
    sets = {r["item"]: frozenset(r.g) for r in names.select("item", retrieval.trigrams(F.col("name")).alias("g")).collect()}
    near = lambda a, b: round(len(a & b) / len(a | b), 9)
    asked = {r.q for r in queries.collect()}
    want = sorted((q, i, near(sets[q], g)) for q in asked for i, g in sets.items() if sets[q] & g and near(sets[q], g) >= 0.75)
    assert sorted((r.q, r["item"], round(r.similarity, 9)) for r in rows) == want
    assert most <= max(len(want), sum(map(len, sets.values())))


def test_resolution_plans_stay_small(spark):
    files = spark.createDataFrame([("src/a.ts",), ("pk/src/b.ts",), ("fs",)], "path string")
    packages = spark.createDataFrame([("pk", "pk", "pk/src/b.ts"), ("@w/q", "pk", "./dist/b.js")], "name string, root string, entry string")
    asked = {("src/c.ts", "./a"): ("FILE", "src/a.ts"), ("src/c.ts", "src/a"): ("EXTERNAL_PACKAGE", "src"), ("src/c.ts", "pk"): ("UNRESOLVED", None), ("src/c.ts", "@w/q"): ("FILE", "pk/src/b.ts"), ("src/c.ts", None): ("UNRESOLVED", None), (None, "./a"): ("UNRESOLVED", None), ("c.ts", "./src/a.js"): ("FILE", "src/a.ts")}
    store = spark._jsparkSession.sharedState().statusStore()
    begin = store.executionsList().size()
    rows = resolve.resolve_imports(spark.createDataFrame(list(asked), "file_path string, specifier string"), files, packages).collect()
    assert {(r.file_path, r.specifier): (r.kind, r.target) for r in rows} == asked and len(rows) == len(asked)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(begin, store.executionsList().size())]
    assert plans and max(map(len, plans)) < 100_000


def test_shingle_keys_travel_with_half_a_fingerprint(spark):
    from loomgraph.llm import neardup

    keyed = spark.createDataFrame([(k, 0, f) for f in (1 << 40, 3 << 50, 3 << 50) for k in (5, 6)] + [(7, 0, 1 << 40)], "key long, salt int, f0 long")
    assert sorted(map(tuple, neardup.collapsed(keyed).collect())) == [(5, 1 << 40), (5, 3 << 50)]
