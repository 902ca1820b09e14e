"""Repeated rows of a vector take no places from others, and an id takes part with all its vectors."""

from __future__ import annotations

from ebbflow.llm import topk_search


def brute(rows: list[tuple[int, list[float]]], query: int, k: int) -> list[tuple]:
    vectors = {(i, tuple(int(256 * x) for x in v)) for i, v in rows}
    scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for i, q in vectors if i == query for j, c in vectors if j != query)
    return [(query, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]


def test_repeated_rows_count_once(spark):
    rows = [(50, [1.0, 0.5]), *[(7, [4.0, 4.0])] * 6, *[(i, [i / 8, 0.0]) for i in range(1, 7)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    want = brute(rows, 50, 5)
    assert len(want) == 5 and sorted(map(tuple, topk_search.search(frame, "id = 50").collect())) == want


def test_an_id_with_several_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 0.5]), (3, [1.0, 0.25]), (4, [0.5, 0.5])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for n in (1, 4):
        got = topk_search.search(frame.repartition(n), "id = 50").collect()
        assert sorted(map(tuple, got)) == brute(rows, 50, 5)
