"""Line deduplication against brute force, whatever partitions and batches cut a line's documents."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from ebbflow.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least: int, keep_first: bool = False) -> list[tuple]:
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((i, t or ""))
    out = []
    for i, t in rows:
        lines, seen, kept = (t or "").split("\n"), set(), []
        for line in lines:
            k = key(line)
            often = k and len(held[k]) >= least
            first = keep_first and often and k not in seen and min(held[k], key=lambda d: (d[0] is not None, d[0] or 0)) == (i, t or "")
            seen.add(k)
            if not often or first:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    common = ["Home | About", " home | about\t", "© 2024 Ünïcode", "x", "---"]
    out = []
    for i in range(400):
        lines = [r.choice(common) if r.random() < 0.5 else f"line {r.randrange(150)}" for _ in range(r.randrange(12))]
        out.append((i, "\n".join(lines)))
    out += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "home | about\n" * 3000), (1004, "a\r\n" * 9), (5, out[5][1]), (5, out[5][1]), (None, "no id\nx"), (1005, "\x85nel stays\x85"), (1006, "X\n" + "y" * 100_000)]
    return out


@pytest.mark.parametrize("least", [2, 3, 10])
def test_brute_force(spark, rows, least):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, keep string, version int").repartition(5)
    assert sorted(map(tuple, line_dedup.line_digests(df, least).collect()), key=str) == brute(rows, least)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_the_first_one_stays(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.line_digests(df, least, keep_first=True).collect()), key=str) == brute(rows, least, True)


def test_one_line_of_all_documents_is_cut_by_range_bounds(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"Same line\nown {i}\nsame line") for i in range(3000)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for first in (False, True):
            assert sorted(map(tuple, line_dedup.line_digests(df, 10, first).collect()), key=str) == brute(rows, 10, first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_streams_in_batches_of_any_size(size, cuts):
    """Partitions cut anywhere, batches of any size: the decided rows and the meeting of bounds are all rows of often held keys."""
    r = random.Random(size * 10 + cuts)
    rows = sorted({(r.randrange(6), 0, r.randrange(12), 0) for _ in range(40)})
    table = pa.table({**{n: pa.array([x[i] for x in rows], pa.int64()) for i, n in enumerate(line_dedup.KEY)}, "places": pa.array([b"\0\0\0\0"] * len(rows), pa.binary())})
    bounds = sorted([0, len(rows), *(r.randrange(len(rows)) for _ in range(cuts - 1))])
    got, edge = [], defaultdict(list)
    for a, b in zip(bounds, bounds[1:], strict=False):
        for batch in line_dedup._decide(3, False)(table.slice(a, b - a).to_batches(max_chunksize=size)):
            for x in batch.to_pylist():
                if x["state"] == line_dedup.DROPPED:
                    got.append((x["h1"], x["doc_id"]))
                else:
                    edge[x["h1"]].append(x)
    for h, xs in edge.items():
        got += [(h, d) for d in line_dedup._meet(3, False)((h, 0), pa.Table.from_pylist(xs))["doc_id"].to_pylist()]
    often = {h for h in range(6) if sum(x[0] == h for x in rows) >= 3}
    assert sorted(got) == sorted((x[0], x[2]) for x in rows if x[0] in often)


def test_documents_keep_their_columns(spark):
    rows = [(i, f"footer\nbody {i}", "e", b"k") for i in range(12)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, version__ string, keep__ binary")
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns
    assert sorted((tuple(x) for x in out.collect()), key=str) == sorted(((i, f"body {i}", "e", b"k") for i in range(12)), key=str) + [(None, None, None, None)]
    assert line_dedup.drop_lines(df.limit(0)).collect() == [] and line_dedup.line_digests(df.limit(0)).collect() == []
