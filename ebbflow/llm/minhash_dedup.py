"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each document's set of word shingles gives its size, a digest of the set and band keys of a MinHash signature.
   Documents with equal sets are one class, which has a number of its own: an id with several texts is in several.
   The text of a class is that of its smallest id.
2. Classes that share a band key belong to one cluster: every class is linked to the smallest class of each of its
   buckets, never to all, and the connected components of those links are the clusters.
3. Inside a cluster, cut into blocks when it is large, each pair of classes with a common band is compared by
   signature batches; after each batch a pair goes when the posterior probability (uniform prior) that its
   similarity reaches the threshold is below the chosen miss probability.  Survivors that are not connected yet are
   verified on their full shingle sets.  A block sends a spanning forest of its verified links, never all pairs.
4. The connected components of the verified links, named by their smallest id and given back to all members of the
   classes, are the result.

Defined results: a null, empty or word-less text has no shingles and is linked with nothing; a text of fewer words
than a shingle is one shingle; documents with a null id are linked with nothing, have a null component and stay; rows that
repeat an id are one document's (they get the same component if their texts are linked); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import MULTIPLIERS, cut, give_back, lowered, mix, small_batches, span_hashes, text_blocks, windows, word_spans
from ebbflow.llm.components import connected_components

#: Words of a shingle and the similarity from which documents are linked, in percent.
WORDS, PERCENT = 5, 80
#: Bands and rows: at a similarity of 0.8, all bands miss with probability (1 - 0.8 ** 5) ** 40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Signature values compared at a time, and the posterior probability under which a pair is dropped.
BATCH, MISS = 40, 1e-5
#: Classes of a block (a larger cluster is compared block by block), and parts that a cluster's classes meet its size in.
BLOCK, SALTS = 96, 16

_A = np.array([int.from_bytes(hashlib.blake2b(b"a%d" % i, digest_size=8).digest(), "little") | 1 for i in range(BANDS * ROWS)], np.uint64)
_X = np.array([int.from_bytes(hashlib.blake2b(b"x%d" % i, digest_size=8).digest(), "little") for i in range(BANDS * ROWS)], np.uint64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches in n signature values with which P(similarity >= threshold) is at least `miss`.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) distributed, and P(Beta >= t) = P(Bin(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a block, of lower-cased words."""
    data = np.append(lowered(data[:-8]), data[-8:])
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    grams, bounds = windows(hashes, first, words)
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        lo, hi = int(first[i]), int(first[i + 1])
        if b > a:
            s = np.sort(grams[a:b])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:  # fewer words than a shingle: the whole sequence is one
            out.append(mix((hashes[lo:hi] * MULTIPLIERS[8 : 8 + hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (BANDS * ROWS of 32 bits) of a non-empty set."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 128):
        low = np.minimum(low, ((shingles[a : a + 128, None] ^ _X) * _A).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band, which its number is part of; sig may hold several signatures."""
    rows = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    return mix((rows * MULTIPLIERS[8 : 8 + ROWS]).sum(axis=-1) + np.arange(BANDS, dtype=np.uint64) * MULTIPLIERS[16])


def _sketch(words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )
        give_back()

    return sketch


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def forest(ids: list[int], sets: list[np.ndarray], sides: list[int], percent: int, miss: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among classes; with two sides, of those between the sides only."""
    sigs = np.array([signature(s) for s in sets])
    keys = band_keys(sigs)
    side = np.array(sides)
    pairs_i, pairs_j = [], []
    for i in range(len(ids) - 1):  # one row of a block against the rest
        meet = (keys[i + 1 :] == keys[i]).any(axis=1)
        if len(set(sides)) > 1:
            meet &= side[i + 1 :] != side[i]
        j = np.flatnonzero(meet) + i + 1
        pairs_i.append(np.full(len(j), i))
        pairs_j.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs_i, pairs_j))
    matches = np.zeros(len(i), np.int64)
    for at in range(0, sigs.shape[1] if len(ids) > 1 else 0, BATCH):
        matches += (sigs[i, at : at + BATCH] == sigs[j, at : at + BATCH]).sum(axis=1)
        alive = matches >= least_matches(at + BATCH, percent / 100, miss)
        i, j, matches = i[alive], j[alive], matches[alive]
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in np.argsort(-matches, kind="stable"):
        a, b = int(i[k]), int(j[k])
        if find(a) != find(b) and _linked(sets[a], sets[b], percent):
            root[find(a)] = find(b)
            out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def _verify(words: int, percent: int, miss: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def verify(key: tuple, table: pa.Table) -> pa.Table:
        ids, sets, sides, seen = [], [], [], set()
        table = table.sort_by([("class_id", "ascending")])
        class_ids, blocks, digests = table["class_id"].to_pylist(), table["block"].to_pylist(), table["digest"].to_pylist()
        for first, last, data, offsets in text_blocks(table["text"]):
            for k, s in zip(range(first, last), shingle_sets(data, offsets, words), strict=True):
                # a repeated id may bring another text: the class's own text is the one with its digest
                if class_ids[k] not in seen and len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digests[k]:
                    seen.add(class_ids[k])
                    ids.append(class_ids[k])
                    sets.append(s)
                    sides.append(blocks[k])
        links = forest(ids, sets, sides, percent, miss) if len(ids) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return verify


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    texts = small_batches(docs).select("doc_id", "text")
    sketches = cut(texts.mapInArrow(_sketch(words), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    classes = sketches.filter("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    classes = cut(classes.withColumn("class_id", F.monotonically_increasing_id()))  # read again from here, the numbers stay
    # one row for each class and band
    banded = sketches.join(classes, ["doc_id", "digest"]).select("class_id", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("class_id").alias("hub"), F.max("class_id").alias("other")).filter("hub < other").select("key", "hub")
    shared = banded.join(hubs, "key").select(F.col("class_id").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    clusters = connected_components(shared)
    verified = _verified_links(texts, classes, clusters, words, percent, miss)
    parts = connected_components(verified).withColumnRenamed("node", "class_id")
    grouped = classes.join(parts, "class_id", "left").select("digest", "doc_id", F.coalesce("component", "class_id").alias("part"))
    named = grouped.join(grouped.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part").select("digest", "component_id")
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _verified_links(texts: DataFrame, classes: DataFrame, clusters: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """(a, b): spanning forests of the verified links of every block, or pair of blocks, of every cluster."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = salted.join(sizes, ["component", "salt"], "left").withColumnRenamed("node", "class_id")
    n_blocks = F.ceil(F.coalesce(F.col("size"), F.lit(1)) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("class_id"), n_blocks).cast("int")
    dealt = members.select("class_id", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("with"))
    dealt = dealt.join(classes, "class_id").select("doc_id", "class_id", "digest", "component", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    held = texts.join(dealt.hint("shuffle_hash"), "doc_id").select("component", "low", "high", "class_id", "block", "digest", "text")
    return held.groupBy("component", "low", "high").applyInArrow(_verify(words, percent, miss), "a long, b long")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their group, all their columns."""
    keep = near_duplicates(docs, words, percent).filter("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
