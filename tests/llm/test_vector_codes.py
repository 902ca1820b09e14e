"""Vector codes against plain Python, and their defined results."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from ebbflow.llm import vector_codes
from ebbflow.llm.common import join_split, shared_folder

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    size = width // parts
    cut = [[(v + [0] * width)[:width][p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for c in cut:
                met.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, members in met.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    return sorted(((i, code, e, by_label[lab], digest) for i, code, e, lab in out), key=str)


def got(df, **how):
    return sorted(map(tuple, vector_codes.compress(df, **how).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, [r.gauss(0, 1) for _ in range(8)], r.choice([0, 0, 0, 1, None])) for i in range(300)]
    out += [(400, None, 1), (401, [float("nan")] * 8, 1), (402, [None] * 8, 1), (403, [float("inf")] * 8, 0), (7, out[7][1], 2), (7, [0.5] * 8, 2), (None, [0.25] * 8, 3), (404, [], 5), (405, [1.0, 2.0], None), (-3, [-0.001] * 8, 9)]
    return out


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_brute_force(spark, rows, rounds):
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"{SCHEMA}, code string").repartition(3)
    exact = [(i, None if v is None else [None if x is None else spark_float(x) for x in v], lab) for i, v, lab in rows]
    assert got(df, parts=4, entries=16, rounds=rounds) == brute(exact, 4, 16, rounds)


def spark_float(x: float) -> float:
    import numpy as np

    return float(np.float32(x))


def test_fewer_vectors_than_entries_ties_and_empty(spark):
    df = spark.createDataFrame([(2, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (3, [1.0, 1.0], 0)], SCHEMA)
    assert [r[1] for r in got(df, parts=2, entries=64)] == ["0000"] * 3
    assert got(df.limit(0)) == [] and got(df.filter("false")) == []
    assert got(spark.createDataFrame([(1, [], None)], SCHEMA))[0][:4] == (1, "00" * 16, 0, 0)


def test_components_beyond_32_bits(spark):
    rows = [(i, [x * 1e12, 1.0], 0) for i, x in enumerate((1.0, 2.0, -5.0, 1.0 + 1e-6, 2.0 + 1e-6))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(df, parts=2, entries=3) == brute(rows, 2, 3, 2)
    far = spark.createDataFrame([(0, [0.0], 0), (1, [1e30], 0)], "vec_id long, embedding array<double>, label int")
    assert got(far, parts=1, entries=2)[1][2] == 0
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(far, parts=1, entries=1).collect()


def test_settled_rounds_send_nothing(spark):
    """Once no assignment changes, a round has no contributions."""
    df = spark.createDataFrame([(i, [float(i % 4), 0.0], 0) for i in range(200)], SCHEMA)
    folder = shared_folder(spark, "settled")
    rows, books = vector_codes.fit(vector_codes.taking_part(df), folder, parts=1, entries=4, rounds=3)
    assert spark.read.parquet(f"{folder}/changes=0").count() == 4
    assert [spark.read.schema("part int").parquet(f"{folder}/changes={i}").count() for i in (1, 2)] == [0, 0]
    back = vector_codes.decode(rows, books).select("vector", "decoded").collect()
    assert all(list(r["vector"]) == r["decoded"] for r in back)


def test_hot_and_null_keys_join_whole(spark):
    df = spark.createDataFrame([("a", i) for i in range(90)] + [(None, 1000 + i) for i in range(60)] + [(f"k{i}", i) for i in range(20)], "k string, x int")
    facts = df.groupBy("k").count()
    out = join_split(df, facts.withColumn("f", facts["count"] * 2), "k", "count", share=10)
    assert {r["k"]: r["f"] for r in out.collect()} == {"a": 180, None: 120} | {f"k{i}": 2 for i in range(20)} and out.count() == df.count()
