"""The pipeline on a small corpus, and the stages' contracts."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, source)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3] == counts[4]
    texts = spark.read.parquet(str(tmp_path / "3"))
    assert docs.select("doc_id").distinct().count() == texts.count()
    whole = corpus_pipeline.run(spark, source)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert whole.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0] and set(columns) <= set(whole.columns)
