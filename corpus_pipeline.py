"""The training-data pipeline: documents through five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, mixing, neardup, pii, quality
from loomgraph.llm.common import materialize, table


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


#: quality rules drop what they reject; of each near-duplicate class the smallest doc_id stays; documents that hold benchmark items
#: go; personal data is replaced by its kind; sources are repeated to their target weights.
STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", neardup.stage),
    ("benchmark decontamination", decontam.stage),
    ("personal data", pii.stage),
    ("source mixing", mix_stage),
]

#: Tokenisers, edit distance and boosted trees aren't SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
