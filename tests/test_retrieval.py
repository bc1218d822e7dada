"""Search, expansion and chunks on hand-made rows, empty ones included."""

from loomgraph.operators import lifecycle, retrieval
from loomgraph.operators.graph import CodeGraph


def test_blocks_of_queries_give_what_one_gives(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 3 = 0").selectExpr("vec_id AS q", "embedding AS qe")
    one, many = (sorted((r.q, r.vec_id) for r in retrieval.nearest_vectors(vectors, queries, 4, block).collect()) for block in (1000, 3))
    assert one == many and len(one) == 20 * 4
    assert retrieval.nearest_vectors(vectors, queries.where("false"), 4).count() == 0


def test_bm25_of_odd_texts(spark):
    texts = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, ""), (4, "Beta, gamma!"), (5, "none")], "item long, text string")
    got = {r["item"]: r.score for r in retrieval.bm25(texts, ["alpha", "beta"]).collect()}
    assert set(got) == {1, 4} and got[1] > got[4] > 0
    assert retrieval.bm25(texts.where("false"), ["alpha"]).count() == 0


def test_trigrams_of_short_and_odd_names(spark):
    names = spark.createDataFrame([(1, "retryPayment"), (2, "retry_payment"), (3, "x"), (4, None), (5, "--")], "item long, name string")
    got = {(r.q, r["item"]): r.similarity for r in retrieval.trigram_search(names, names.selectExpr("item AS q", "name"), 0.3).collect()}
    assert got[1, 1] == got[3, 3] == 1.0 and (1, 2) in got and not any(4 in k or 5 in k for k in got)


def test_expansion_keeps_the_best_score_and_ends_in_cycles(spark):
    edges = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("a", "d", "IMPORTS")]
    graph = CodeGraph(spark.createDataFrame([(k,) for k in "abcd"], "stable_key string"), spark.createDataFrame([(*e, str(i)) for i, e in enumerate(edges)], "source string, target string, edge_type string, edge_key string"))
    hits = spark.createDataFrame([("a", 1.0), ("b", 0.2)], "stable_key string, score double")
    got = {r.stable_key: (r.score, r.hop) for r in retrieval.expand(graph, hits, {"CALLS": 0.5}, 3).collect()}
    assert got == {"a": (1.0, 0), "b": (0.5, 1), "c": (0.5, 1)}


def test_chunks_end_with_their_text(spark):
    files = spark.createDataFrame([("f", "1\n2\n3"), ("n", None)], "path string, text string")
    ranges = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 3, 9), ("f", "c", 4, 5), ("f", "d", 2, 1), ("n", "e", 1, 1), ("gone", "g", 1, 1)], "path string, entity string, start_line int, end_line int")
    assert {r.entity: r.chunk for r in retrieval.chunks(files, ranges).collect()} == {"a": "1\n2", "b": "3"}


def test_blobs_are_read_back(spark):
    import hashlib

    key = lambda b: f"source/sha256/{hashlib.sha256(b).hexdigest()[:2]}/{hashlib.sha256(b).hexdigest()}"
    stored = spark.createDataFrame([(key(b"ab"), b"ab"), (key(b"cd"), b"xy"), (key(b"ef"), b"long"), (key(b""), b"")], "object_key string, content binary")
    expected = spark.createDataFrame([(key(b"ab"), 2), (key(b"cd"), 2), (key(b"ef"), 2), (key(b"gh"), 2), ("k", 1), (key(b""), 0)], "object_key string, n_bytes int")
    got = {r.object_key: r.status for r in lifecycle.verify_blobs(stored, expected).collect()}
    assert got == {key(b"ab"): "VERIFIED", key(b"cd"): "WRONG_HASH", key(b"ef"): "WRONG_LENGTH", key(b"gh"): "MISSING", "k": "MALFORMED_KEY", key(b""): "VERIFIED"}
