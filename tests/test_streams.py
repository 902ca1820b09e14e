"""Streams give exactly what batches give, for keys and values of every type, and for the stateful operators' options."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ebbflow import functions as fn
from ebbflow import sinks
from ebbflow.operators.aggregates import count, greatest, invertible, kmax, kmin, least, recomputed, total
from ebbflow.plans import Options, Relation
from ebbflow.session import shared_folder
from ebbflow.signed import SIGN
from ebbflow.sources import text as sources
from ebbflow.streaming import lowering
from ebbflow.streaming.processors import KEY, ROW, ExtremeDelta, JoinDelta, SumDelta
from ebbflow.streaming.run import net, replay, run_available, run_for, state_of, state_rows, timings

BIG = 9007199254740993
TYPES = {
    "boolean": [True, False, None], "int": [1, -2, None], "bigint": [BIG, BIG + 1, None], "double": [0.1, -0.0, 0.0, float("inf"), float("-inf"), float("nan"), None], "float": [0.1, 1e-30, float("nan"), -3.5, None],
    "decimal(30,5)": [Decimal("123456789012345678901.00001"), Decimal("1.5"), None], "string": ["", "é\"\\\n", None], "binary": [b"\x00\xff", b"", None],
    "date": [date(1969, 12, 31), date(2024, 2, 29), None], "timestamp": [datetime(2024, 1, 1, 0, 0, 0, 333), datetime(2024, 1, 1, 0, 0, 0, 666), None], "timestamp_ntz": [datetime(1960, 1, 1, 0, 0, 0, 1), datetime(1960, 1, 1, 0, 0, 0, 2), None],
    "array<int>": [[1, None], [], None], "struct<a:bigint,b:string>": [(BIG, None), (BIG + 1, "x"), None],
}


def rows(df) -> Counter:
    return Counter(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def typed(spark):
    def frame(kind: str):
        values = TYPES[kind]
        data = [(v, i % 5, s) for i, v in enumerate(values * 3) for s in ((1, 1) if i % 2 else (1,))] + [(values[0], 0, -1)]
        return spark.createDataFrame(data, f"v {kind}, i int, {SIGN} int")

    return frame


@pytest.mark.parametrize("kind", TYPES)
def test_keys_of_every_type(typed, kind):
    df = typed(kind)
    query = lambda r: r.group("g", ["v"], count("n"), total("i", "s", "long"))
    assert rows(query(Relation.load(replay(df, 2), "s")).rows()) == rows(query(Relation.load(df, "b")).rows())


@pytest.mark.parametrize("kind", [k for k in TYPES if k not in ("boolean", "binary") and not k.startswith(("array", "struct"))])
def test_extremes_of_every_type(typed, kind):
    df = typed(kind)
    query = lambda r: r.group("g", ["i"], kmin("v", "lo", kind), kmax("v", "hi", kind))
    assert rows(query(Relation.load(replay(df, 3), "s")).rows()) == rows(query(Relation.load(df, "b")).rows())


@pytest.mark.parametrize("how", ["left", "right", "full", "semi", "anti"])
def test_a_stream_beside_a_static_side(spark, how):
    left = spark.createDataFrame([(BIG, "a"), (BIG + 1, "b"), (BIG + 1, "b"), (None, "n")], "k long, x string")
    right = spark.createDataFrame([(BIG + 1, 2**60 + 1), (BIG + 1, None), (7, 40), (None, 0)], "k long, y long")
    batch = Relation.load(left, "l").join("j", Relation.load(right, "r"), ["k"], how).rows()
    for a, b in ((replay(left, 2), right), (left, replay(right, 2))):
        live = Relation.load(a, "l").join("j", Relation.load(b, "r"), ["k"], how).rows()
        assert rows(live.select(*batch.columns)) == rows(batch)


def test_cogroup_of_streams(spark):
    left = spark.createDataFrame([(1, BIG, 1), (1, BIG, 1), (1, None, 1), (2, 5, 1), (2, 5, -1), (None, 6, 1)], f"k int, x long, {SIGN} int")
    right = spark.createDataFrame([(1, "a", 1), (3, "b", 1), (None, "c", 1)], f"k int, y string, {SIGN} int")
    batch = Relation.load(left, "l").cogroup("c", Relation.load(right, "r"), ["k"]).rows()
    live = Relation.load(replay(left, 3), "l").cogroup("c", Relation.load(replay(right, 2), "r"), ["k"]).rows()
    assert rows(live) == rows(batch) and live.count() == 4


def test_only_one_side_has_a_window(spark):
    r = Relation.load(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), "r")
    windowed = r.count_window("w", ["k"], 2, count("n"), order=["v"])
    assert windowed.cogroup("c", r, ["k"]).rows().count() == 1
    with pytest.raises(ValueError, match="one side"):
        windowed.filter("n > 0", "f").cogroup("c", r.count_window("x", ["k"], 3, count("n"), order=["v"]), ["k"])


@pytest.mark.parametrize("flat", [True, False])
def test_count_each_on_a_stream(spark, flat):
    df = spark.createDataFrame([(1, "A", 1), (1, "A", 1), (1, "C", 1), (1, "C", -1), (2, None, 1), (2, "B", 1)], f"k int, alpha string, {SIGN} int")
    query = lambda r: r.count_each("e", ["k"], "alpha", "bag", flat)
    assert rows(query(Relation.load(replay(df, 3), "s")).rows()) == rows(query(Relation.load(df, "b")).rows())


def second_moment(value: str = "v"):
    return invertible(value, "m", "long", {"q": lambda v: (v * v).cast("long"), "n": lambda v: F.lit(1).cast("long")}, lambda s: s["q"] // s["n"] if s["n"] else None, lambda s: F.when(s["n"] != 0, F.floor(s["q"] / s["n"])))


def test_an_aggregate_with_an_inverse(spark):
    df = spark.createDataFrame([(k, v, s) for k in range(3) for v, s in ((4, 1), (6, 1), (None, 1), (6, -1), (k, 1))], f"k int, v int, {SIGN} int")
    query = lambda r: r.group("g", ["k"], second_moment(), count("n"))
    expected = {repr((k, (16 + k * k) // 2, 3)): 1 for k in range(3)}
    assert rows(query(Relation.load(df, "b")).rows()) == rows(query(Relation.load(replay(df, 2), "s")).rows()) == expected
    with pytest.raises(ValueError, match="sum"):
        Relation.load(replay(df, 2), "s").group("g", ["k"], second_moment(), least("v", "lo", "int"))


def test_extremes_come_back_over_many_batches(spark):
    added = [(1, v, 1) for v in (5, 3, 9, 7)]
    taken = [(1, 3, -1), (1, 9, -1), (1, 5, -1), (1, 7, -1)]
    steps = [(i, *r) for i, r in enumerate(added + taken + [(1, 8, 1)])]
    live = replay(spark.createDataFrame(steps, f"at int, k int, v int, {SIGN} int"), 6, "at").drop("at")
    assert rows(Relation.load(live, "s").group("g", ["k"], kmin("v", "lo", "int"), kmax("v", "hi", "int")).rows()) == {"(1, 8, 8)": 1}


def test_values_that_mix_with_sums(spark):
    df = spark.createDataFrame([(1, BIG, 1), (1, None, 1), (1, BIG + 2, 1), (1, BIG, -1)], f"k int, v long, {SIGN} int")
    aggregates = (count("n"), count("known", "v"), total("v", "s", "long"), greatest("v", "hi"), recomputed("v", "d", "long", lambda: F.count_distinct("v"), lambda c: sum(n > 0 for v, n in c.items() if v is not None)))
    query = lambda r: r.group("g", ["k"], *aggregates)
    assert rows(query(Relation.load(replay(df, 2), "s")).rows()) == rows(query(Relation.load(df, "b")).rows()) == {repr((1, 2, 1, BIG + 2, BIG + 2, 1)): 1}


def test_state_is_dropped_after_its_time(spark):
    folder, source = shared_folder(spark, "ttl-out"), shared_folder(spark, "ttl-in")
    query = lambda: Relation.load(spark.readStream.schema("k int").parquet(source), "s", {"g": Options(ttl_ms=1)}).group("g", ["k"], count("n"))
    for _ in range(2):
        spark.createDataFrame([(1,)], "k int").write.mode("append").parquet(source)
        run_available(query().df, folder, 2)
    assert rows(spark.read.parquet(f"{folder}/rows").select("k", "n", SIGN)) == {repr((1, 1, 1)): 2}  # forgotten in between


def test_state_can_be_read(spark):
    folder = shared_folder(spark, "inspect")
    df = replay(spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, v long"), 2)
    out = run_available(Relation.load(df, "s").group("g", ["k"], total("v", "s", "long")).df, folder, 2)
    assert rows(net(out)) == {"(1, 30)": 1, "(2, 5)": 1}
    held = {r["key"]: json.loads(r["values"]) for r in state_rows(spark, folder).collect()}
    assert held == {'{"f0":1}': [2, 2, 30], '{"f0":2}': [1, 1, 5]}
    assert [json.loads(r["values"]) for r in state_of(spark, folder, {"k": 1}, "k int").collect()] == [[2, 2, 30]]
    assert state_of(spark, folder, {"k": 9}, "k int").count() == 0


def test_one_bucket_of_many_keys(spark, monkeypatch):
    """One bucket of many keys over several batches, some of which come and go."""
    monkeypatch.setattr(lowering.group, "__defaults__", (*lowering.group.__defaults__[:-1], 1))
    df = spark.range(1500).selectExpr("id % 500 AS k", "id AS v", f"1 AS {SIGN}").unionByName(spark.range(500).filter("id % 3 = 0").selectExpr("id AS k", "id AS v", f"-1 AS {SIGN}"))
    query = lambda r: r.group("g", ["k"], count("n"), total("v", "s", "long"))
    assert rows(query(Relation.load(replay(df, 4), "s")).rows()) == rows(query(Relation.load(df, "b")).rows())


def test_settings_of_the_session_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    Relation.load(replay(spark.createDataFrame([(1,)], "k int"), 1), "s").group("g", ["k"], count("n")).rows(state_partitions=3).collect()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_group_over_partitions_of_its_own(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    plan = lambda *keys: replace(Relation.load(df, "in"), options={"g": Options(parallel=7)}).group("g", list(keys), total("v", "s", "long")).df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan("k") and plan("k").count("Exchange") == 1 and ", 7)" in plan("k") and "RoundRobin" not in plan("k")


def test_a_users_function_over_batches(spark):
    def twice(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.compute.multiply(b.column("k"), 2), b.column(SIGN)], names=["k", SIGN])

    df = spark.createDataFrame([(1, 1), (2, 1), (2, -1)], f"k int, {SIGN} int")
    for source in (df, replay(df, 2)):
        assert rows(net(run_available(r.df) if (r := Relation.load(source, "s").map_batches("m", twice, "k long")).streaming else r.df)) == {"(2,)": 1}


def test_additions_and_retractions_are_counted(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1, 1), (2, 2), (2, -1)], f"k int, {SIGN} int")
    seen = Observation("seen")
    frame = df.observe(seen, F.count("*").alias("n"))
    assert Relation.load(df, "s").observe("o").rows().count() == 2 and frame.count() == 3
    live = Relation.load(replay(df, 1), "s").observe("passed").df
    query = live.writeStream.format("noop").option("checkpointLocation", shared_folder(spark, "observed")).trigger(availableNow=True).start()
    query.awaitTermination()
    metrics = [p.observedMetrics["passed"] for p in query.recentProgress if "passed" in p.observedMetrics]
    assert sum(m["added"] or 0 for m in metrics) == 3 and sum(m["taken_back"] or 0 for m in metrics) == 1


def test_a_jump_of_new_keys_and_then_known_keys_only(spark):
    """400,000 keys in three equal batches, with and without a time to live: every earlier row is taken back."""
    source = shared_folder(spark, "jump-in")
    for _ in range(3):
        spark.range(400_000).coalesce(1).write.mode("append").parquet(source)
    for ttl in (None, 10_000_000):
        df = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        out = Relation.load(df, "s", {"g": Options(ttl_ms=ttl)} if ttl else {}).group("g", ["id"], count("n"))
        assert rows(out.rows().groupBy("n").count()) == {"(3, 400000)": 1}


class Clock:
    def __init__(self, now: int):
        self.now = now

    def getCurrentProcessingTimeInMs(self) -> int:
        return self.now


class Handle:
    """State variables in memory, for processors that are called by hand."""

    def __init__(self):
        from test_pages import State

        self.maps, self.make = {}, State

    def getMapState(self, name, key, value, ttl=None):
        return self.maps.setdefault(name, self.make())

    def getValueState(self, name, schema, ttl=None):
        held = self.maps.setdefault(name, self.make())

        class One:
            exists = staticmethod(lambda: 0 in held)
            get = staticmethod(lambda: held.get(0))
            update = staticmethod(lambda v: held.update({0: v}))
            clear = staticmethod(lambda: held.pop(0, None))

        return One

    def registerTimer(self, at):
        pass


def by_hand(processor, inputs, ttls=(None, None)):
    processor.inputs, processor.ttls = inputs, ttls
    handle = Handle()
    processor.init(handle)

    def call(rows, now=0, key="k"):
        out = [tuple(r) for f in processor.handleInputRows((key,), iter([pd.DataFrame(rows, columns=inputs)]), Clock(now)) for r in f.itertuples(index=False)]
        return sorted(out, key=str)

    return call, handle


SIDED = [KEY, "meets__", "side__", ROW, SIGN]


def test_sums_live_from_their_own_last_change():
    """200 keys; batches at 0, 11 and 25 s with a time to live of 20 s: keys touched at 11 s go on, the others start anew."""
    parts = StructType.fromDDL("r long, p0_n long")
    call, _ = by_hand(SumDelta([count("n")], parts), [KEY, "r", "p0_n"], (20_000, None))
    step = lambda keys, now: call([(f"k{i}", 1, 1) for i in keys], now)
    assert len(step(range(200), 0)) == 200
    assert len(step(range(100), 11_000)) == 200  # 2 for 1
    last = Counter(r[1:] for r in step(range(200), 25_000))
    assert last == {(3, 1): 100, (2, -1): 100, (1, 1): 100}


def test_a_change_reads_nothing_of_its_own_side():
    """One row more on a side of 100,000 rows reads a page of it, and the other side's one row."""
    call, handle = by_hand(JoinDelta("full"), SIDED)
    call([("k", True, 0, f"r{i}", 1) for i in range(100_000)] + [("k", True, 1, "s", 1)])
    for s in handle.maps.values():
        s.calls = 0
    assert call([("k", True, 0, "new", 1)]) == [("k", "new", "s", 1)]
    assert handle.maps["left"].calls <= 8 and handle.maps["right"].calls <= 2


def test_an_extreme_taken_back_reads_no_other_row():
    values = StructType.fromDDL("v long")
    call, handle = by_hand(ExtremeDelta([kmin("v", "lo"), kmax("v", "hi")], values), [KEY, ROW, SIGN])
    text = lambda v: '{"f0":%d}' % v
    call([("k", text(i), 1) for i in range(50_000)])
    for s in handle.maps.values():
        s.calls = 0
    assert call([("k", text(0), -1)]) == sorted([("k", '{"f0": 1, "f1": 49999}', 1), ("k", '{"f0": 0, "f1": 49999}', -1)], key=str)
    assert sum(s.calls for s in handle.maps.values()) <= 20


def test_one_side_is_forgotten_and_the_other_kept():
    """State options by input: left rows live 100 ms, right rows for ever."""
    call, _ = by_hand(JoinDelta("inner"), SIDED, (100, None))
    assert call([("k", True, 0, "a", 1), ("k", True, 1, "x", 1)], 0) == [("k", "a", "x", 1)]
    assert call([("k", True, 1, "y", 1)], 200) == []  # a has gone
    assert call([("k", True, 0, "b", 1)], 210) == [("k", "b", "x", 1), ("k", "b", "y", 1)]


def test_options_of_inputs_reach_their_state(spark):
    folder, left, right = (shared_folder(spark, n) for n in ("sides-out", "sides-left", "sides-right"))
    read = lambda path, schema: spark.readStream.schema(schema).parquet(path)
    query = lambda: Relation.load(read(left, "k int, x string"), "l", {"j": Options(input_ttl_ms={0: 1})}).join("j", Relation.load(read(right, "k int, y string"), "r"), ["k"])
    for i in range(2):
        spark.createDataFrame([(1, f"x{i}")], "k int, x string").write.mode("append").parquet(left)
        spark.createDataFrame([(1, f"y{i}")], "k int, y string").write.mode("append").parquet(right)
        run_available(query().df, folder, 2)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/rows").select("x", "y", SIGN).collect()} == {("x0", "y0", 1), ("x1", "y0", 1), ("x1", "y1", 1)}


@pytest.mark.parametrize("how", ["left", "right", "full", "anti", "semi", "inner"])
def test_a_static_side_is_the_state_that_a_stream_begins_with(spark, how):
    """Sides in both orders, keys of one side only, null keys, and a stream that takes rows back."""
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "b", -1), (2, "c", 1), (None, "n", 1), (4, "d", 1), (4, "d", -1)], f"k int, x string, {SIGN} int")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s"), (4, "t")], "k int, y string")
    batch = Relation.load(left, "l").join("j", Relation.load(right, "r"), ["k"], how).rows()
    live = lowering.join(replay(left, 3), right, ["k"], how, native=False)
    assert rows(net(run_available(live, state_partitions=2)).select(*batch.columns)) == rows(batch)
    live = lowering.join(left.filter(f"{SIGN} > 0"), replay(right, 2), ["k"], how, native=False)
    batch = Relation.load(left.filter(f"{SIGN} > 0"), "l").join("j", Relation.load(right, "r"), ["k"], how).rows()
    assert rows(net(run_available(live, state_partitions=2)).select(*batch.columns)) == rows(batch)


def test_a_static_side_is_no_second_stream(spark):
    orders, customers = spark.range(9).selectExpr("id AS k", "id AS o"), spark.range(5).selectExpr("id * 2 AS k", "id AS c")
    plan = lowering.join(replay(orders, 2), customers, ["k"], "full")._jdf.queryExecution().logical().toString()
    assert plan.count("StreamingRelation") == 1


@pytest.mark.parametrize("side", [0, 1])
def test_windows_of_one_input_beside_all_of_the_other(spark, side):
    events = [(k, i) for i in range(23) for k in (1, 2, None)] + [(5, 1)]
    facts = [(1, "a", 1), (1, "b", 1), (1, "b", -1), (1, "c", 1), (3, "z", 1), (None, "n", 1)]
    e = spark.createDataFrame(events, "k int, at int")
    f = spark.createDataFrame(facts, f"k int, name string, {SIGN} int")
    options = {"c": Options(windows={side: 5})}

    def query(e, f, **order):
        a, b = Relation.load(e, "e", options), Relation.load(f, "f", options)
        out = a.cogroup("c", b, ["k"], **order) if side == 0 else b.cogroup("c", a, ["k"], **order)
        sizes = out.foreach("n", "k", "window_id", "size(left_rows) AS l", "size(right_rows) AS r")
        return rows(sizes.rows())

    batch = query(e, f, order=["at"])
    assert query(replay(e, 3), replay(f, 2)) == batch
    assert batch[repr((1, 4, 3, 2) if side == 0 else (1, 4, 2, 3))] == 1 and batch[repr((3, None, None, 1) if side == 0 else (3, None, 1, None))] == 1


def test_windows_by_input_are_checked(spark):
    r = Relation.load(spark.createDataFrame([(1, 1)], "k int, v int"), "r", {"c": Options(windows={0: 2, 1: 2}), "d": Options(windows={0: 2})})
    with pytest.raises(ValueError, match="one side"):
        r.cogroup("c", r, ["k"], order=["v"])
    with pytest.raises(ValueError, match="order"):
        r.cogroup("d", r, ["k"])


def test_a_stream_is_dealt_once_by_buckets_of_keys(spark):
    df = replay(spark.range(1000).selectExpr("id % 10 AS k", "id AS v"), 2, "k")
    out = Relation.load(df, "in", {"g": Options(parallel=7)}).group("g", ["k"], total("v", "s", "long"))
    plan = out.df._jdf.queryExecution().logical().toString()
    assert not re.search(r"Repartition\b", plan) and re.search(r"pmod\(xxhash64.*cast\(7 as bigint\)\) AS bucket__", plan)
    assert rows(out.rows()) == rows(Relation.load(spark.range(1000).selectExpr("id % 10 AS k", "id AS v"), "b").group("g", ["k"], total("v", "s", "long")).rows())


def test_one_key_is_numbered_by_many_tasks(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 < 9, 7, id % 3) AS k", "20000 - id AS v").repartition(6)
    rel = Relation.load(df, "d")
    w = rel.count_window("w", ["k"], 50, count("n"), kmin("v", "lo"), order=["v"])
    want = Counter()
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1
    plain = df.withColumn("w", F.floor(place / 50)).groupBy("k", "w").agg(F.count("*").alias("n"), F.min("v").alias("lo"))
    want = rows(plain.select("k", F.col("w").cast("long"), "n", "lo"))
    assert rows(w.rows().select("k", "window_id", "n", "lo")) == want
    assert "row_number" not in w.df._jdf.queryExecution().optimizedPlan().toString()


def test_upserts_write_what_they_touch(spark):
    """A batch of one key writes one bucket; the others stay as they are; a batch that is run again changes nothing."""
    folder = shared_folder(spark, "upsert-buckets")
    store = sinks.upsert(folder, ["k"], "v", buckets=16)
    schema = StructType.fromDDL("k int, v int, x string")
    batch = lambda rows: spark.createDataFrame(rows, f"k int, v int, x string, {SIGN} int")
    store(batch([(i, 1, "a", 1) for i in range(200)]), 0)
    for _ in range(2):
        store(batch([(7, 0, "b", 1), (7, 0, "gone", -1), (900, 3, "new", 1)]), 1)
    store(batch([]), 2)
    got = {r["k"]: (r["v"], r["x"]) for r in sinks.upserted(spark, folder, 2, schema).collect()}
    assert got == {i: (1, "a") for i in range(200)} | {7: (0, "b"), 900: (3, "new")}  # later batches win
    assert sinks.upserted(spark, folder, 0, schema).count() == 200
    held = sinks.manifest(spark, folder, 2)
    assert len(held) == 16 and sum(b == 1 for b in held.values()) == len({b for b, i in held.items() if i == 1}) <= 2
    assert spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/data/batch=1").count() < 60


def test_a_live_run_loses_nothing(spark):
    live = Relation.load(sources.rate(spark, 2000, 8, 1000), "r").foreach("k", "cast(cur_sent AS bigint) % 10 AS k").observe("fed")
    seen = lambda progress: sum(p.observedMetrics["fed"]["added"] or 0 for p in progress if "fed" in p.observedMetrics)
    out, progress = run_for(live.group("g", ["k"], count("n")).df, 60, lambda p: seen(p) >= 1000, state_partitions=2)
    counts = net(out).collect()
    assert sum(r["n"] for r in counts) >= seen(progress) >= 1000
    assert timings(progress)["rows"] >= 1000 and timings(progress)["p99_ms"] >= timings(progress)["p50_ms"] > 0
    assert timings(progress, "fed")["rows"] == seen(progress) and timings(progress, "other")["rows"] == 0


def test_json_steps_with_dots_and_quotes(spark):
    text = '{"a.b": {"it\'s": [1, {"x": null}]}, "a": {"b": 2}, "n": null, "e": ""}'
    df = spark.createDataFrame([(text,), (None,), ("{",)], "j string")
    got = [r[0] for r in df.select(fn.json_path("a.b/it's a/b a.b/it\"s n e n/x", F.col("j"))).collect()]
    assert got == [{"a.b/it's": '[1,{"x":null}]', "a/b": "2", 'a.b/it"s': "", "n": "null", "e": "", "n/x": ""}, None, {"error": "Could not parse: {"}]
    with pytest.raises(ValueError, match="quotes"):
        fn.json_path("a'\"", F.col("j"))
