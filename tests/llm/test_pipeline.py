"""The pipeline against its stages done by hand on their own operators' verdicts."""

import corpus_pipeline
from loomgraph.llm import pii
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from loomgraph.llm import decontam, quality, tokencount

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    paths = tokencount.vocabulary_path(quality.BYTE_VOCABULARY), tokencount.vocabulary_path(quality.PIECE_VOCABULARY)
    kept = {r.doc_id for r in quality.rules(docs, *paths).where("kept").collect()}
    kept = {i for i, (_, c) in brute_classes([(i, rows[i].text) for i in sorted(kept)]).items() if i == c}
    kept -= {r.doc_id for r in decontam.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.doc_id for r in got} <= kept
    assert len({r.doc_id for r in got}) > 0.4 * len(kept)
    trees = pii.model()
    assert all(not pii.base_spans(r.text) for r in got)
    changed = {i for i in kept if pii.all_spans(rows[i].text, trees)[1]}
    assert all((r.text == rows[r.doc_id].text) == (r.doc_id not in changed) for r in got)
    assert set(docs.columns) <= set(corpus_pipeline.run(spark, SF).columns)


def test_stages_judge_rows(spark):
    """Null and repeated doc_ids: each row goes by its own text, and one row of each near-duplicate class stays."""
    from loomgraph.llm import decontam, neardup, quality

    first, second, third = (r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en' AND length(text) BETWEEN 800 AND 3000").orderBy("doc_id").dropDuplicates(["text"]).limit(3).collect())
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first().text
    schema = "doc_id long, text string, lang string, extra int"
    frame = lambda *rows: spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], schema)
    left = lambda df: sorted(r.extra for r in df.collect())

    kept = quality.stage(spark, frame((1, first), (1, "short"), (None, second), (None, "short"), (None, None)), SF)
    assert left(kept) == [0, 2] and kept.columns == ["doc_id", "text", "lang", "extra"]
    assert left(decontam.stage(spark, frame((1, first), (1, f"a {item} b"), (None, second), (None, f"c {item}"), (None, None)), SF)) == [0, 2, 4]
    for parts in (1, 4):
        docs = frame((5, first), (5, first), (None, first), (None, second), (None, second), (7, third), (7, first), (9, third + " end"), (3, None), (None, ""))
        rows = neardup.stage(spark, docs.repartition(parts, "extra"), SF).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted([(5, first), (0, second), (7, third), (3, ""), (0, "")])
