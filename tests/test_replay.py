"""Replayed tables keep their ranges apart: a value of few, or a range without rows, never joins another micro-batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ebbflow.session import shared_folder
from ebbflow.signed import SIGN
from ebbflow.streaming import run
from ebbflow.streaming.run import replay, run_available


def batches(spark, live) -> dict[int, set]:
    folder = shared_folder(spark, "replayed")
    run_available(live.withColumn(SIGN, F.lit(1)), folder)
    out: dict[int, set] = {}
    for r in spark.read.parquet(f"{folder}/rows").select("batch", "at").distinct().collect():
        out.setdefault(r[0], set()).add(r[1])
    return {i: at for i, at in sorted(out.items())}


@pytest.mark.parametrize("file_bytes", [1 << 20, 0])
def test_each_of_few_values_is_a_batch(spark, monkeypatch, file_bytes):
    """Three of ten rows come first: the median is the second value, and both were one micro-batch."""
    monkeypatch.setattr(run, "FILE_BYTES", file_bytes)
    df = spark.range(10).selectExpr("id", "CASE WHEN id < 3 THEN 0 ELSE 1 END AS at")
    assert list(batches(spark, replay(df, 2, "at")).values()) == [{0}, {1}]


def test_a_range_with_fewer_rows_than_files(spark, monkeypatch):
    monkeypatch.setattr(run, "FILE_BYTES", 0)
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 2 THEN 0 WHEN id < 99 THEN 1 ELSE 2 END AS at")
    assert list(batches(spark, replay(df, 3, "at")).values()) == [{0}, {1}, {2}]
