"""What comes to state processors: rows summed over many batches, packed by bucket, hot keys dealt over parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ebbflow.operators.aggregates import kmax, kmin
from ebbflow.plans import Relation
from ebbflow.queries import _window_cogroup
from ebbflow.signed import SIGN
from ebbflow.sources import text as sources
from ebbflow.streaming import lowering
from ebbflow.streaming.run import replay, run_for


def test_sums_go_over_many_batches():
    batch = pa.RecordBatch.from_pydict({"k0": [1, 2, 1, None], "n": [1, 1, 1, 1]})
    out = pa.Table.from_batches(lowering._combine(["k0"], ["n"])([batch] * 30)).to_pydict()
    assert dict(zip(out["k0"], out["n"], strict=True)) == {1: 60, 2: 30, None: 30} and len(out["k0"]) == 3


def test_rows_are_packed_by_bucket():
    schema = pa.schema([("key__", pa.string()), ("n", pa.int64())])
    batch = pa.RecordBatch.from_pydict({"bucket__": [5, 3, 5], "key__": ["a", "b", None], "n": [1, 2, 3]})
    got = [(r["bucket__"], pa.ipc.read_record_batch(pa.py_buffer(r["packed__"]), schema).to_pylist()) for out in lowering._pack(schema)([batch, batch]) for r in out.to_pylist()]
    assert [b for b, _ in got] == [3, 5] and got[0][1] == [{"key__": "b", "n": 2}] * 2
    assert sorted(map(str, got[1][1])) == sorted(map(str, [{"key__": "a", "n": 1}, {"key__": None, "n": 3}] * 2))


def test_extremes_of_a_hot_key_are_dealt(spark):
    df = replay(spark.range(2000).selectExpr("id % 2 AS k", "id AS v"), 2)
    g = Relation.load(df, "s").group("g", ["k"], kmin("v", "lo"), kmax("v", "hi"))
    assert g.df._jdf.queryExecution().logical().toString().count("TransformWithState") == 2
    assert {tuple(r) for r in g.rows().collect()} == {(0, 0, 1998), (1, 1, 1999)}


def test_windows_stand_beside_sums(spark):
    events = Relation.load(spark.range(400).selectExpr("id AS event_id", "id AS user_id"), "e")
    out = _window_cogroup(events, Relation.load(spark.range(300).selectExpr("id AS c_custkey"), "c"), order=["event_id"])
    assert "GROUP known" in out.describe() and out.rows().count() == 75


def test_a_live_run_without_an_end(spark):
    live = sources.rate(spark, 1000, 8, 1000).select(F.col("cur_sent"), SIGN)
    out, progress = run_for(live, None, lambda p: sum(b.numInputRows for b in p) >= 100)
    assert out.count() >= 100
