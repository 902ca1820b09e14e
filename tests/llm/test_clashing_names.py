"""Operators that keep their input's columns keep those with the operators' own names too."""

from __future__ import annotations

import pytest

from ebbflow.llm import minhash_dedup, secret_scan, suffix_dedup, topk_search, toxicity

NAMES = ["__blob", "__spans", "__score", "blob", "spans", "salt", "Score", "chunk", "rest", "component_id", "kept", "digest", "bands", "__n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "password=hunter2hunter2 and more", *NAMES), (2, None, *NAMES), (None, "password=hunter2hunter2 and more", *NAMES), (1, "password=hunter2hunter2 and more", *NAMES)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


def test_other_columns_stay(docs, labels):
    for out in (secret_scan.mask_secrets(docs), toxicity.reject_toxic(docs, labels), minhash_dedup.drop_near_duplicates(docs), suffix_dedup.cut_repeats(docs, length=50)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == 4 and all(tuple(r)[2:] == tuple(NAMES) for r in rows)
    assert {r["text"] for r in secret_scan.mask_secrets(docs).collect()} == {None, "*" * 23 + " and more"}


@pytest.mark.parametrize("kind,value", [("int", 3), ("string", "three"), ("double", 3.5), ("long", 3)])
def test_a_column_of_counts_of_any_type(spark, kind, value):
    passage = "a passage of more than fifty bytes that two documents share whole. "
    df = spark.createDataFrame([(1, passage, value), (2, passage + "own", value), (None, "x", value), (3, None, None)], f"doc_id long, text string, n_chars {kind}")
    got = {r["doc_id"]: r["n_chars"] for r in suffix_dedup.cut_repeats(df, length=50).collect()}
    assert got[2] == (3 if kind in ("int", "long") else value) and suffix_dedup.cut_repeats(df.limit(0), length=50).count() == 0


def test_large_components(spark):
    """Components beyond 32 bits count exactly; scores that might leave 64 bits fail."""
    v = spark.createDataFrame([(0, [9e6, 1.0]), (50, [9e6, -2.0]), (1, [-8.5e6, 0.5])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk_search.search(v, "id % 50 = 0").collect()}
    w = {0: (256 * 9 * 10**6, 256), 50: (256 * 9 * 10**6, -512), 1: (-256 * 85 * 10**5, 128)}
    assert got == {(q, c): sum(a * b for a, b in zip(w[q], w[c], strict=True)) for q in (0, 50) for c in w if c != q}
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(huge, "id % 50 = 0").collect()


@pytest.mark.parametrize("rows", [
    [(0, [1e8]), (1, [0.5])], [(0, [1e8, 0.0]), (50, [0.0, 1e8]), (1, [0.5, 0.25])], [(0, [1e30, 1.0]), (1, [0.0, 2.0]), (2, [-1e30, 5.0]), (3, [0.0, 1.0]), (4, [-0.25, 0.0])],
])
def test_large_components_beside_small_ones(spark, rows):
    """Scores are exact whatever a block's other rows hold, a query's own among them; only a result beyond 64 bits fails."""
    k = 5 if len(rows) < 5 and rows[0][1][0] < 1e30 else 2
    w = {i: [int(256 * x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in w if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(w[q], w[c], strict=True)), c) for c in w if c != q)[:k]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    got = topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), "id % 50 = 0", k=k)
    assert {tuple(r) for r in got.collect()} == want
