"""Quality rules: base text statistics and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Two multinomials over hashed word n-grams (n = 1, 2) are counted: one over the trusted target (documents labelled
of good quality), one over the whole raw corpus.  A document's verdict is the mean log ratio of its n-grams, so that
length does not matter; documents at or above a fixed threshold stay.

Defined results: a null or word-less text has all counts 0 and a score of 0, and fails the base rule (fewer than 50
words); a document without label counts in the raw corpus alone; several labels of one document count as its best;
repeated rows are kept, one result each; an empty table gives an empty result; without any trusted document the
target is the raw corpus and every score is 0; a very long text is read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import mix, span_hashes, text_blocks, windows, word_spans

#: log2 of the number of hashed n-gram buckets; the model is two arrays of that size, whatever the corpus.
BUCKET_BITS = 18
#: Pseudo-counts that every bucket has beside its n-grams, in the target and in a raw corpus of the target's size.
PRIOR = 5.0
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
SLICE = 16384

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _ngram_buckets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and their documents' bounds, then of all word pairs and theirs; each has half the buckets."""
    shift, half = np.uint64(65 - BUCKET_BITS), 1 << (BUCKET_BITS - 1)
    pairs, bounds = windows(hashes, first, 2)
    return (mix(hashes) >> shift).astype(np.int64), first, (pairs >> shift).astype(np.int64) + half, bounds


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense bucket counts of a task's documents, raw and trusted, in slices."""
    size = 1 << BUCKET_BITS
    counts = {False: np.zeros(size, np.int64), True: np.zeros(size, np.int64)}
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").to_pylist(), bool)
        for first, last, data, offsets in text_blocks(batch.column("text")):
            starts, ends, bounds = word_spans(data, offsets)
            one, b1, two, b2 = _ngram_buckets(span_hashes(data, starts, ends), bounds)
            counts[False] += np.bincount(one, minlength=size) + np.bincount(two, minlength=size)
            good = trusted[first:last]
            if good.any():
                for keys, b in ((one, b1), (two, b2)):
                    counts[True] += np.bincount(keys[np.repeat(good, np.diff(b))], minlength=size)
    if counts[False].any():
        cuts = range(0, size, SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // SLICE for i in cuts], pa.int32()), *[pa.array([counts[k][i : i + SLICE].astype("<u4").tobytes() for i in cuts], pa.binary()) for k in (False, True)]],
            names=["slice", "raw", "target"],
        )


def _add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(SLICE, np.int64), np.zeros(SLICE, np.int64)
    for batch in rows:
        for total, name in ((raw, "raw"), (target, "target")):
            for part in batch.column(name):
                total += np.frombuffer(part.as_buffer(), "<u4")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], names=["slice", "raw", "target"])


def corpus_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all documents: (raw, target).  Each task sends its sums once, never single n-grams."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("trusted")).filter("trusted")
    marked = docs.select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    parts = marked.mapInArrow(_count, "slice int, raw binary, target binary")
    merged = parts.groupBy("slice").applyInArrow(_add, "slice int, raw binary, target binary")
    raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for row in merged.collect():  # 2 ** BUCKET_BITS counts, whatever the corpus
        at = row["slice"] * SLICE
        raw[at : at + SLICE] = np.frombuffer(row["raw"], np.int64)
        target[at : at + SLICE] = np.frombuffer(row["target"], np.int64)
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target / p_raw of every bucket; buckets that little is known about are drawn towards 0."""
    expected = raw * (int(target.sum()) / max(int(raw.sum()), 1))
    return np.log((target + prior) / (expected + prior))


def _line_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """n_dup_lines of each document: lines with a word that equal an earlier line of the document."""
    n = int(offsets[-1])
    breaks = np.flatnonzero(data[:n] == 10)
    begins = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    doc = np.searchsorted(offsets, begins, "right") - 1
    # a break at the very end of a document begins an empty last line that belongs to it, without words
    begins, doc = begins[doc < len(offsets) - 1], doc[doc < len(offsets) - 1]
    stops = np.append(begins[1:], n)
    stops = np.where(np.isin(stops - 1, breaks), stops - 1, stops) if len(breaks) else stops
    stops = np.minimum(stops, offsets[doc + 1])
    at = np.searchsorted(starts, begins)
    worded = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < stops) if len(starts) else np.zeros(len(begins), bool)
    begins, stops, doc = begins[worded], stops[worded], doc[worded]
    key = mix(span_hashes(data, begins, np.maximum(stops, begins)) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(doc[same], minlength=len(offsets) - 1)


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """n_repeat_words of each document: words inside 3-word windows that the document holds twice or more."""
    h3, bounds = windows(hashes, first, 3)
    out = np.zeros(len(first) - 1, np.int64)
    if not len(h3):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
    key = mix(h3 + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    hit = np.flatnonzero(twice)
    word = hit - bounds[doc[hit]] + first[doc[hit]]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[word + k] = True
    total = np.concatenate(([0], np.cumsum(covered)))
    return total[first[1:]] - total[first[:-1]]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of a block of documents."""
    n = int(offsets[-1])
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    one, b1, two, b2 = _ngram_buckets(hashes, first)
    n_grams = np.diff(b1) + np.diff(b2)
    points = np.concatenate(([0], np.cumsum((data[:n] & 0xC0) != 0x80)))  # code points before each byte
    total = np.array([ratios[one[a:b]].sum() + ratios[two[c:d]].sum() for a, b, c, d in zip(b1[:-1], b1[1:], b2[:-1], b2[1:], strict=True)])
    return {
        "n_words": np.diff(first), "word_chars": _sums(points[ends] - points[starts], first), "n_symbols": _sums(_SYMBOLS[data[:n]], offsets),
        "n_dup_lines": _line_counts(data, offsets, starts), "n_repeat_words": _repeat_words(hashes, first), "score": total / np.maximum(n_grams, 1),
    }


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _judge(ratios: np.ndarray, threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("text")):
                got = measure(data, offsets, ratios)
                failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
                kept = ~failed & (np.round(got["score"], 9) >= threshold)
                longs = [pa.array(got[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), *longs, pa.array(failed), pa.array(kept), pa.array(got["score"].astype(np.float64))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
                )

    return judge


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    ratios = log_ratios(*corpus_counts(docs, labels), prior).astype(np.float64)
    return docs.select("doc_id", "text").mapInArrow(_judge(ratios, threshold), OUT)
