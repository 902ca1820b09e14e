"""Golden results and the law that a stream's net rows are the batch result over all input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ebbflow import functions as fn
from ebbflow import sinks
from ebbflow.operators import relational
from ebbflow.operators.aggregates import average, count, greatest, kmax, kmin, least, recomputed, total
from ebbflow.plans import Options, Relation
from ebbflow.session import shared_folder
from ebbflow.signed import SIGN, consolidate, difference, expanded, negate, net_rows, positive
from ebbflow.sources import text as sources
from ebbflow.streaming.run import net, replay, run_available

#: The sentences of the golden results. (fixed values)
SENTENCES = [
    "pepsi pepsi pepsi pepsi pepsi pepsi pepsi.", "The quick brown fox jumped over the lazy dog.", "The quick brown fox jumped over the lazy dog.",
    "The quick brown fox jumped over the lazy dog.", "Mary had a little lamb.", "This will be encoded into json.", "defeat of deduct went over defence before detail?",
]


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame([(s,) for s in SENTENCES], "sentence string")


def words(r: Relation) -> Relation:
    return r.flatten("t", fn.tokenize(F.col("sentence")), "w").foreach("words", fn.lower(F.col("w")).alias("word"))


def hist(r: Relation) -> Relation:
    return words(r).group("counts", ["word"], count("wc")).group("hist", ["wc"], count("freq"))


HIST = {(3, 6): 1, (4, 1): 1, (1, 19): 1, (6, 2): 1}


def test_histogram_of_word_counts(sentences):
    assert rows(hist(Relation.load(sentences, "s")).rows()) == HIST


def test_histogram_as_a_stream(sentences):
    assert rows(hist(Relation.load(replay(sentences, 2), "s")).rows()) == HIST


def test_extremes_of_word_counts(sentences):
    counts = words(Relation.load(sentences, "s")).group("counts", ["word"], count("wc"))
    assert rows(counts.group("x", [], kmin("wc", "lo"), kmax("wc", "hi")).rows()) == {(1, 6): 1}


def test_count_windows(sentences):
    the = words(Relation.load(sentences, "s")).filter("word = 'the'", "the").foreach("k", "word", "1 AS one")
    assert rows(the.count_window("w", ["word"], 2, count("wc"), order=["one"]).foreach("r", "word", "wc").rows()) == {("the", 2): 3}
    live = words(Relation.load(replay(sentences, 3), "s", {"w": Options(window=2)})).filter("word = 'the'", "the")
    assert rows(live.group("w", ["word"], count("wc")).foreach("r", "word", "wc").rows()) == {("the", 2): 3}


def test_windows_refuse_retractions(spark):
    signed = Relation.load(spark.createDataFrame([(1, 1), (1, -1)], f"k int, {SIGN} int"), "s")
    with pytest.raises(ValueError):
        signed.count_window("w", ["k"], 2, count(), order=["k"])


def test_stopwords(spark, sentences):
    stop = Relation.load(spark.createDataFrame([("the",), ("a",), ("of",)], "word string"), "stop")
    w = words(Relation.load(sentences, "s"))
    assert rows(w.join("j", stop, ["word"], replicated=True).group("g", ["word"], count()).rows()) == {("the", 6): 1, ("a", 1): 1, ("of", 1): 1}
    assert sum(rows(w.join("a", stop, ["word"], "anti").rows()).values()) == sum(rows(w.rows()).values()) - 8


ADDED = [(k, v, 1) for k in range(4) for v in range(5)]
TAKEN = [(1, 0, -1), (1, 4, -1), (2, 0, -1), (2, 1, -1), (2, 2, -1), (2, 3, -1), (2, 4, -1), (3, 2, -1)]


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame(TAKEN + ADDED, f"k int, v int, {SIGN} int")


AGGREGATES = (count("n"), total("v", "s", "long"), least("v", "lo", "int"), greatest("v", "hi", "int"))
EXPECTED = {(0, 5, 10, 0, 4): 1, (1, 3, 6, 1, 3): 1, (3, 4, 8, 0, 4): 1}


def test_retractions_bring_back_the_runner_up(changes):
    assert rows(Relation.load(changes, "c").group("g", ["k"], *AGGREGATES).rows()) == EXPECTED


def test_retractions_in_a_stream_and_before_their_additions(changes):
    live = replay(changes.withColumn("at", F.col(SIGN)), 2, "at").drop("at")
    assert rows(Relation.load(live, "c").group("g", ["k"], *AGGREGATES).rows()) == EXPECTED


def test_sums_only_stream_and_average(changes):
    g = lambda r: r.group("g", ["k"], count("n"), average("v", "a"))
    assert rows(g(Relation.load(changes, "c")).rows()) == rows(g(Relation.load(replay(changes, 3), "c")).rows()) == {(0, 5, 2.0): 1, (1, 3, 2.0): 1, (3, 4, 2.0): 1}


def test_any_aggregate_is_retractable(changes):
    middle = recomputed("v", "m", "int", lambda: F.count_distinct("v").cast("int"), lambda c: sum(n > 0 for n in c.values()))
    g = lambda r: r.group("g", ["k"], middle)
    assert rows(g(Relation.load(changes, "c")).rows()) == rows(g(Relation.load(replay(changes, 2), "c")).rows()) == {(0, 5): 1, (1, 3): 1, (3, 4): 1}


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_joins_of_streams_equal_batch_joins(spark, how):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b", 1), (3, "c", 1), (3, "c", -1), (None, "n", 1)], f"k int, x string, {SIGN} int")
    right = spark.createDataFrame([(2, 20, 1), (2, 21, 1), (2, 21, -1), (3, 30, 1), (4, 40, 1), (None, 0, 1)], f"k int, y int, {SIGN} int")
    batch = Relation.load(left, "l").join("j", Relation.load(right, "r"), ["k"], how).rows()
    live = Relation.load(replay(left, 2), "l").join("j", Relation.load(replay(right, 3), "r"), ["k"], how).rows()
    assert rows(batch) == rows(live.select(*batch.columns))


def test_distinct_and_union(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, -1), (3, 1)], f"k int, {SIGN} int")
    assert rows(Relation.load(df, "d").distinct("x").rows()) == rows(Relation.load(replay(df, 2), "d").distinct("x").rows()) == {(1,): 1, (3,): 1}
    both = Relation.load(df, "a").union("u", Relation.load(df, "b"))
    assert rows(net_rows(both.df)) == {(1,): 4, (3,): 2}


def test_cogroup(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, 5), (3, 6)], "k int, y int")
    got = {r["k"]: (r["left_rows"], r["right_rows"]) for r in relational.cogroup(left, right, ["k"]).collect()}
    assert got == {1: ([Row(x="a")] * 2, None), 2: ([Row(x="b")], [Row(y=5)]), 3: (None, [Row(y=6)])}


def test_count_each(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, "C"), (1, "B")], "k int, alpha string")
    assert rows(relational.count_each(df, ["k"], "alpha").drop(SIGN)) == {(1, "A", 2): 1, (1, "C", 1): 1, (1, "B", 1): 1}
    bag = relational.count_each(df, ["k"], "alpha", "bag", flat=False).first()["bag"]
    assert [tuple(x) for x in bag] == [("A", 2), ("B", 1), ("C", 1)]


def test_sign_algebra(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    d = difference(a, b)
    assert rows(d) == {(1, -1): 1, (2, -1): 1, (3, 1): 1}
    assert rows(net_rows(positive(a).unionByName(d))) == rows(b)
    assert consolidate(positive(a).unionByName(negate(a))).isEmpty()
    assert rows(expanded(consolidate(positive(a)))) == {(1, 1): 2, (2, 1): 1}


def test_signed_text_feeds_another_query(spark, changes):
    folder = shared_folder(spark, "test")
    sinks.signed_tab_text(changes, folder)
    back = sources.signed_tab_text(spark, folder, [("k", "int"), ("v", "int")])
    assert rows(Relation.load(back, "c").group("g", ["k"], *AGGREGATES).rows()) == EXPECTED
    assert sum(rows(sinks.positives(changes)).values()) == len(ADDED)
    live = sources.signed_tab_text(spark, folder, [("k", "int"), ("v", "int")], stream=True)
    assert rows(Relation.load(live, "c").group("g", ["k"], count("n")).rows()) == {(0, 5): 1, (1, 3): 1, (3, 4): 1}


def test_tab_text_casts(spark):
    folder = shared_folder(spark, "test")
    spark.createDataFrame([("1\tx",), ("no",), ("",)], "value string").write.text(folder)
    assert rows(sources.tab_text(spark, folder, [("a", "int"), ("b", "string")]).drop(SIGN)) == {(1, "x"): 1, (None, None): 2}
    assert sources.text_lines(spark, folder).count() == 3


def test_restart_goes_on_from_the_checkpoint(spark):
    source, folder = shared_folder(spark, "in"), shared_folder(spark, "out")
    run = lambda: net(run_available(Relation.load(spark.readStream.schema("k int").parquet(source), "s").group("g", ["k"], count("n")).df, folder, 2))
    spark.createDataFrame([(1,), (2,)], "k int").write.parquet(source)
    assert rows(run()) == {(1, 1): 1, (2, 1): 1}
    spark.createDataFrame([(1,)], "k int").write.mode("append").parquet(source)
    assert rows(run()) == {(1, 2): 1, (2, 1): 1}
    assert rows(run()) == {(1, 2): 1, (2, 1): 1}


def test_upsert_sink_keeps_the_last_addition(spark):
    folder = shared_folder(spark, "upsert")
    store = sinks.upsert(folder, ["k"], "at")
    frame = lambda *r: spark.createDataFrame(list(r), f"k int, v int, at int, {SIGN} int")
    store(frame((1, 10, 1, 1), (2, 20, 1, 1)), 0)
    for _ in range(2):  # again, as after a failure
        store(frame((1, 10, 1, -1), (1, 11, 2, 1)), 1)
    assert rows(sinks.upserted(spark, folder, 1, frame().drop("at", SIGN).schema)) == {(1, 11): 1, (2, 20): 1}


def test_json_path(spark):
    sample = '{"id": 123, "created_at":"4321", "none": null, "user":{"screen_name": [1,2,3]}}'
    df = spark.createDataFrame([(sample,), ("{bad",), (None,)], "j string")
    got = [r["m"] for r in df.select(fn.json_path("id created_at user/screen_name missing id/below none", F.col("j")).alias("m")).collect()]
    assert got[0] == {"id": "123", "created_at": "4321", "user/screen_name": "[1,2,3]", "missing": "", "id/below": "", "none": "null"}
    assert got[1] == {"error": "Could not parse: {bad"} and got[2] is None


def test_functions(spark):
    df = spark.createDataFrame([("Wed Aug 27 13:08:45 +0000 2008", "a:b:c", 'x "y",(z)*')], "t string, s string, w string")
    iso = fn.custom_format_to_iso(F.col("t"), "EEE MMM dd HH:mm:ss Z yyyy")
    r = df.select(iso.alias("iso"), fn.iso_to_minute(iso).alias("m"), fn.strsplit(F.col("s"), ":", 2, "p", "q").alias("p"), fn.tokenize(F.col("w")).alias("w"), fn.length(F.col("s")).alias("n")).first()
    assert (r["iso"], r["m"], tuple(r["p"]), r["w"], r["n"]) == ("2008-08-27T13:08:45.000Z", "2008-08-27T13:08Z", ("a", "b:c"), ["x", "y", "z"], 5)
    # means of max(0, ceil(N(m, s))); a size that is drawn twice where it is zero would give 40.1 in place of 45.3
    for mean, std, want, spread in ((5, 2, 5.5, 2.0), (42.671, 36.722, 45.336, 32.997)):
        for seed in (1, None):
            size = spark.range(20_000).select(fn.random_bag(mean, std, seed).alias("b")).select(F.size("b").alias("n"), F.size(F.array_distinct("b")).alias("own"))
            got, own = size.agg(F.avg("n"), F.avg("own")).first()
            assert abs(got - want) < 6 * spread / 20_000**0.5 and abs(own - got) < 0.01
    assert spark.range(50).select(F.size(fn.random_bag(-100, 1)).alias("n")).agg(F.max("n")).first()[0] == 0
    assert spark.range(5).select(fn.delay(0.0).alias("d")).agg(F.sum("d")).first()[0] == 0
    with pytest.raises(Exception, match="equal"):
        spark.range(3).select(fn.raise_when_equal(F.col("id"), F.lit(2))).collect()


def test_empty_tables(spark):
    empty = Relation.load(spark.createDataFrame([], "k int, v int"), "e")
    assert empty.group("g", ["k"], *AGGREGATES).rows().isEmpty()
    assert empty.group("g", [], count("n")).rows().isEmpty()
    assert empty.join("j", empty, ["k"], "full").rows().isEmpty()


def test_explain_and_options(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    r = Relation.load(df, "in", {"f": Options(parallel=3), "g": Options(shuffle_before=True)}).filter("k > 1", "f").group("g", ["k"], count("n"))
    assert r.describe().splitlines() == ["LOAD in static", "FILTER f", "GROUP g"]
    assert "== Physical Plan ==" in r.explain()
    loaded = Relation.load(df, "in", {"in": Options(parallel=5)})
    assert loaded.explain().count("RoundRobinPartitioning(5)") == loaded.explain().count("REPARTITION_BY_NUM") == 1 and sorted(x[0] for x in loaded.rows().collect()) == list(range(10))
    with pytest.raises(ValueError):
        Relation.load(df.selectExpr("k", "k"), "twice")


def test_broadcast_only_what_is_known_to_be_small(spark):
    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    plan = relational.join(big, small, ["k"], replicated=True, limit_bytes=1)
    assert rows(plan.select("k")) == {(i,): 1 for i in range(5)}
    assert relational.size_bound(small) < 1 << 20
