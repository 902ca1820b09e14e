"""Inner joins of two streams: state by buckets of keys, equal rows as one with their weight, pairs one by one."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from test_streams import SIDED, Clock, by_hand

from ebbflow.plans import Options, Relation
from ebbflow.signed import SIGN
from ebbflow.streaming import lowering
from ebbflow.streaming.processors import LARGEST, JoinDelta
from ebbflow.streaming.run import replay, run_available, state_rows


@pytest.mark.parametrize("native", [False, True])
def test_two_streams_are_joined_by_buckets(spark, native):
    """Null keys, keys of one side, copies, and rows that are taken back, on both sides."""
    left = spark.createDataFrame([(i % 7 if i % 9 else None, i % 4, 1) for i in range(60)] + [(1, 1, -1), (6, 9, 1)], f"k int, x int, {SIGN} int")
    right = spark.createDataFrame([(i % 5, i % 3, 1) for i in range(20)] + [(3, 0, -1), (None, 1, 1), (11, 1, 1)], f"k int, y int, {SIGN} int")
    options = {"j": Options(native=native)}
    batch = Relation.load(left, "l").join("j", Relation.load(right, "r"), ["k"]).rows()
    live = Relation.load(replay(left, 3), "l", options).join("j", Relation.load(replay(right, 2), "r"), ["k"])
    assert live.df._jdf.queryExecution().logical().toString().count("TransformWithState") == (0 if native else 1)
    assert Counter(map(tuple, live.rows(2).collect())) == Counter(map(tuple, batch.collect()))


def test_equal_rows_are_one_in_state(spark, tmp_path):
    left = Relation.load(replay(spark.range(400).selectExpr("id % 2 AS k"), 2), "l")
    right = Relation.load(replay(spark.range(2).selectExpr("id AS k", "id + 5 AS y"), 1), "r")
    out = run_available(left.join("j", right, ["k"]).df, str(tmp_path), 2)
    assert {tuple(r) for r in out.groupBy("k", "y").sum(SIGN).collect()} == {(0, 5, 200), (1, 6, 200)}
    assert sorted(r["values"] for r in state_rows(spark, str(tmp_path), "left").collect()) == ["[200]", "[200]"]


def test_equal_rows_are_packed_as_one():
    schema = pa.schema([("row__", pa.string()), (SIGN, pa.int64())])
    batch = pa.RecordBatch.from_pydict({"bucket__": [5, 3, 5, 5], "row__": ["a", "a", None, "a"], SIGN: [1, 2, 1, -3]})
    got = {r["bucket__"]: pa.ipc.read_record_batch(pa.py_buffer(r["packed__"]), schema).to_pylist() for out in lowering._pack(schema)([batch, batch]) for r in out.to_pylist()}
    assert {b: {r["row__"]: r[SIGN] for r in rows} for b, rows in got.items()} == {3: {"a": 4}, 5: {"a": -4, None: 2}} and len(got[5]) == 2


def test_weights_fit_in_an_int():
    call, _ = by_hand(JoinDelta("inner"), SIDED)
    out = call([("k", True, 0, "a", 100_000), ("k", True, 1, "x", 100_000)])
    assert sum(r[3] for r in out) == 10**10 and max(r[3] for r in out) == LARGEST
    out = call([("k", True, 0, "a", -100_000)])
    assert sum(r[3] for r in out) == -(10**10) and min(r[3] for r in out) == -LARGEST


def test_pairs_of_a_key_are_not_held():
    """A million pairs come in frames: only the rows that make them are in memory."""
    join = JoinDelta("inner")
    by_hand(join, SIDED)
    rows = pd.DataFrame([("k", True, side, f"r{i}", 1) for side in (0, 1) for i in range(1000)], columns=SIDED)
    tracemalloc.start()
    first = next(join.handleInputRows(("k",), iter([rows]), Clock(0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(first) == 50_000 and peak < 40 << 20
