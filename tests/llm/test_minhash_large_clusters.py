"""Clusters larger than a group: nothing that all pairs would link is lost, and recall at the threshold."""

from __future__ import annotations

import random

import pytest

from ebbflow.llm import minhash_dedup


def shingles(text: str, n: int = 4) -> frozenset:
    w = text.split(" ")
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False))


def components(texts: dict[int, str]) -> dict[int, int]:
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("block", [8, 96])
def test_a_percolating_cluster_equals_brute_force(spark, monkeypatch, block):
    """Documents that share half of their text hang together by chance bands; chains of near copies run through them."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(block)
    common, texts = [f"c{i}" for i in range(70)], {}
    for g in range(30):
        words = common + [f"g{g}w{i}" for i in range(rng.choice([12, 30, 60]))]
        for k in range(rng.choice([1, 2, 6])):
            texts[1000 - len(texts)] = " ".join(words)
            words = list(words)
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(70, len(words))] = f"new{g}x{k}"
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=4).collect()}
    want = components(texts)
    assert got == want and 5 < len(set(want.values())) < len(want)


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = random.Random(8)
    texts, linked = {}, []
    while len(linked) < 400:
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(60, 160))]
        other = list(words)
        while True:
            other[rng.randrange(len(other))] = f"n{rng.randrange(10**6)}"
            a, b = shingles(" ".join(words)), shingles(" ".join(other))
            if 100 * len(a & b) < 82 * len(a | b):
                break
        if 100 * len(a & b) >= 80 * len(a | b):
            i = len(texts)
            texts |= {i: " ".join(words), i + 1: " ".join(other)}
            linked.append((i, i + 1))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=4).collect()}
    assert sum(got[b] == a for a, b in linked) / len(linked) == 1.0
