"""Sums of many keys as Arrow columns: a bucket's keys at a time, in pages of thousands, with the results of single keys."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from test_pages import State
from test_streams import Clock, Handle

from ebbflow.operators.aggregates import average, count, total
from ebbflow.plans import Options, Relation
from ebbflow.session import shared_folder
from ebbflow.streaming import lowering, pages
from ebbflow.streaming.processors import BUCKET, HASH, KEY, PACKED, ColumnSums, SumDelta, sums_by
from ebbflow.streaming.run import net, replay, run_available, state_of, state_rows

PARTS = ["__rows", "p0_n", "p1_n", "p1_s", "p2_n", "p2_s"]
SCHEMA = pa.schema([(HASH, pa.int32()), (KEY, pa.string()), *[(p, pa.float64() if p == "p2_s" else pa.int64()) for p in PARTS]])


def test_known_keys_are_read_by_thousands(spark):
    """20,000 keys of one bucket, all of them changed by each of three micro-batches."""
    folder = shared_folder(spark, "columns")
    df = replay(spark.range(60_000).selectExpr("id % 20000 AS k", "id DIV 20000 AS at"), 3, "at")
    out = run_available(Relation.load(df, "s", {"g": Options(parallel=1)}).group("g", ["k"], count("n"), total("at", "v", "long")).df, folder, 1)
    assert [tuple(r) for r in net(out).groupBy("n", "v").count().collect()] == [(3, 3, 20_000)]
    held = spark.read.format("statestore").option("stateVarName", "sums").load(f"{folder}/checkpoint")
    assert held.count() <= 20_000 // 1000
    assert state_rows(spark, folder).select("key", "values").distinct().count() == 20_000
    assert [r["values"] for r in state_of(spark, folder, {"k": 77}, "k long").collect()] == ["[3,3,3,3]"]


def test_keys_of_texts_and_nulls_in_state(spark):
    folder = shared_folder(spark, "columns")
    keys = ["a\x1f\"\\é\n", "\\u00ab", "", None]
    df = replay(spark.createDataFrame([(k, True) for k in keys * 2], "k string, b boolean"), 2)
    run_available(Relation.load(df, "s").group("g", ["k", "b"], count("n")).df, folder, 2)
    for k in keys:
        assert [r["values"] for r in state_of(spark, folder, {"k": k, "b": True}, "k string, b boolean").collect()] == ["[2,2]"]


@pytest.mark.parametrize("seed", range(4))
def test_columns_give_what_single_keys_give(monkeypatch, seed):
    monkeypatch.setattr(pages, "COLUMN_KEYS", 8)
    r = random.Random(seed)
    aggregates = [count("n"), total("v", "s", "long"), average("w", "a")]
    columns, single = ColumnSums(aggregates, [KEY], PARTS), SumDelta(aggregates, StructType([StructField(p, DoubleType() if p == "p2_s" else LongType()) for p in PARTS]))
    handles = Handle(), Handle()
    for p, h, inputs in ((columns, handles[0], [BUCKET, PACKED]), (single, handles[1], [KEY, *PARTS])):
        p.inputs = inputs
        p.init(h)
    columns.packed = SCHEMA
    held: dict = {}
    for step in range(25):
        rows = []
        for _ in range(r.choice([1, 2, 40, 300]) if step < 24 else 0):
            k = r.randrange(200)
            if held.get(k) and r.random() < 0.6:
                rows.append((k, [-x for x in held[k].pop()]))
            else:
                known, v = r.random() < 0.8, r.randrange(-5, 5)
                held.setdefault(k, []).append([1, 1, int(known), v * known, int(known), v * known / 4])
                rows.append((k, held[k][-1]))
        if step == 24:  # all that is left is taken back
            rows = [(k, [-x for x in v]) for k, vs in held.items() for v in vs]
        texts = [f"k{k}" for k, _ in rows]
        batch = pa.RecordBatch.from_arrays([pa.array([zlib.crc32(str(k).encode()) >> 1 for k in texts], pa.int32()), pa.array(texts, pa.string()), *[pa.array([v[i] for _, v in rows], SCHEMA.field(p).type) for i, p in enumerate(PARTS)]], schema=SCHEMA)
        cells = [b.serialize().to_pybytes() for b in (batch.slice(0, len(rows) // 3), batch.slice(len(rows) // 3))]
        got = list(columns.handleInputRows((1,), iter([pd.DataFrame({BUCKET: [1, 1], PACKED: cells})]), Clock(0)))
        want = list(single.handleInputRows((1,), iter([pd.DataFrame([(k, *v) for k, (_, v) in zip(texts, rows, strict=True)], columns=[KEY, *PARTS])]), Clock(0)))
        plain = lambda frames: sorted((tuple(None if pd.isna(x) else x for x in row) for f in frames for row in f.itertuples(index=False)), key=str)
        assert plain(got) == plain(want)
        assert all(a >= b for f in got for a, b in zip(f.iloc[:, -1], f.iloc[1:, -1], strict=False))
        if step == 20:
            assert len(handles[0].maps["sums"]) > 4
    assert not handles[0].maps["sums"] or list(handles[0].maps["sums"]) == [(0,)]  # at most the layout


@pytest.mark.parametrize("size", [1, 7, 500])
def test_pages_of_columns_are_a_table(monkeypatch, size):
    monkeypatch.setattr(pages, "COLUMN_KEYS", size)
    schema, r, state, want = pa.schema([("h", pa.int32()), ("v", pa.int64())]), random.Random(size), State(), {}
    for step in range(30):
        table = pages.ColumnPages(state, schema, "h")
        keys = pa.chunked_array([pa.array([r.randrange(-(2**31), 2**31) for _ in range(r.choice([1, 5, 200]))] + r.sample(sorted(want), len(want) // 2), pa.int32())])
        at = table.pages_of(keys)
        held = dict(zip(*(c.to_pylist() for c in table.load(at).columns), strict=True))
        assert held.items() <= want.items() and all(k in held for k in set(keys.to_pylist()) & set(want))
        gone = {k for k in held if r.random() < 0.3}
        new = {k: v for k, v in held.items() if k not in gone} | {k: step for k in keys.to_pylist()}
        want = {k: v for k, v in want.items() if k not in held} | new
        table.store(at, pa.table({"h": pa.array(list(new), pa.int32()), "v": pa.array(list(new.values()), pa.int64())}))
        again = pages.ColumnPages(state, schema, "h")
        assert dict(zip(*(c.to_pylist() for c in again.load(set(range(again.pages))).columns), strict=True)) == want
    assert again.pages > len(want) // (3 * size) and all(k < again.pages for k, in state)


def test_sums_beyond_64_bits_fail():
    schema, top = pa.schema([("k", pa.int64()), ("v", pa.int64())]), (1 << 63) - 1
    table = lambda *v: pa.table({"k": [1] * len(v), "v": v}, schema=schema)
    assert sums_by(table(top, 5, -5), ["k"], ["v"]).cast(schema)["v"].to_pylist() == [top]
    with pytest.raises(pa.ArrowInvalid):
        sums_by(table(top, 1), ["k"], ["v"]).cast(schema)


def test_cells_of_long_rows_are_small():
    schema = pa.schema([(KEY, pa.string()), ("n", pa.int64())])
    batch = pa.RecordBatch.from_pydict({BUCKET: np.zeros(500, np.int64), KEY: [f"{i:04d}" * 500 for i in range(500)], "n": [1] * 500})
    cells = [c for out in lowering._pack(schema)([batch]) for c in out[PACKED].to_pylist()]
    assert max(map(len, cells)) < 2 * lowering.PACKED_BYTES
    assert sum(pa.ipc.read_record_batch(pa.py_buffer(c), schema).num_rows for c in cells) == 500


def test_other_keys_and_aggregates(spark):
    """Keys that are kept as texts, no keys, averages, ints and distinct rows: as a batch has them."""
    rows = lambda df: sorted(map(repr, df.collect()))
    df = spark.range(300).select((F.col("id") % 7).alias("k"), (F.col("id") % 3 / 2).alias("d"), F.when(F.col("id") % 5 > 0, F.col("id").cast("int")).alias("v"))
    for keys in (["k"], ["d"], ["k", "d"], []):
        query = lambda r: r.group("g", keys, average("v", "a"), total("v", "s", "int"), total("d", "t"), count("c", "v"))  # noqa: E731, B023
        assert rows(query(Relation.load(replay(df, 3), "s")).rows()) == rows(query(Relation.load(df, "b")).rows())
    assert rows(Relation.load(replay(df.select("k", "d"), 3), "s").distinct("x").rows()) == rows(df.select("k", "d").distinct())
