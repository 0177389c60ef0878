"""The pipeline's stages on the smallest tables: each takes all that the one before kept."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark):
    import corpus_pipeline as P
    from quireflow.llm.common import staged

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = P.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.filter("piece = 0").count() == docs.count()
