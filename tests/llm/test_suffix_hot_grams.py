"""A k-gram that stands in many different contexts is dealt over several buckets, with the same result."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from ebbflow.llm import suffix_dedup

COMMON = "0000 a common key 0000 "


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [say(rng.randint(30, 80)) for _ in range(10)]
    rows = [(i, "".join(part for _ in range(4) for part in (rng.choice(passages) if rng.random() < 0.4 else say(40), COMMON))) for i in range(150)]
    return rows + [(None, rows[0][1]), (7, rows[3][1]), (7, rows[3][1]), (500, None), (501, COMMON * 40)]


def removed(rows: list, length: int) -> Counter:
    first: dict = {}
    out = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k : k + length], i) < i:
                gone[k : k + length] = True
        out.append((i, len(data), int(gone.sum())))
    return Counter(out)


@pytest.mark.parametrize("hot", [3, 40, suffix_dedup.HOT])
def test_hot_grams(spark, texts, hot):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame, 50, chunk_bytes=2000, hot=hot).filter("doc_id is not null").select("doc_id", "n_bytes", "n_removed")
    assert Counter(tuple(r) for r in got.collect()) == removed(texts, 50)


def test_common_prefixes():
    data = np.frombuffer(b"abcdefghijklmnop" * 2 + b"abcdefghijkX" + bytes(20), np.uint8)
    assert suffix_dedup.common_prefix(data, np.array([0, 0, 1]), np.array([16, 32, 2]), 12).tolist() == [12, 11, 0]


def test_documents_without_an_id_are_spread(spark):
    """Chunks are dealt by text too: a million documents without an id are not one group."""
    docs = spark.range(400).selectExpr("cast(null as long) AS doc_id", "cast(id AS string) AS text")
    whole, _ = suffix_dedup._found(docs, 50, 6 << 20, suffix_dedup.HOT)
    assert whole.select("chunk").distinct().count() > 32
