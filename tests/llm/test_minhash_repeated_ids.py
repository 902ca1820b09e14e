"""An id with two texts has the links of both."""

from __future__ import annotations

import itertools

from ebbflow.llm import minhash_dedup


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(120)) for p in "ab")
    rows = [(5, a), (5, b), (7, a + " end"), (9, b + " end"), (11, "apart from all of them")]
    for first in itertools.permutations(rows[:2]):
        frame = spark.createDataFrame([*first, *rows[2:]], "doc_id long, text string").coalesce(1)
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame, words=4, percent=80).collect())
        assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True)]


def test_the_sql_gives_the_same_for_repeated_ids(spark):
    import duckdb
    import pandas as pd

    from ebbflow.llm import sql

    a, b = (" ".join(f"{p}{i}" for i in range(120)) for p in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (9, b + " end"), (11, "apart from all of them"), (None, a), (12, None), (13, "a b")]
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]})  # noqa: F841
    want = duckdb.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({sql.OP1})").fetchall()
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=80)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == sorted(want, key=str)
