"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of hashed byte n-grams (4 to 8 bytes, ASCII letters lower-cased) is the feature set: all 2^20 buckets.  Fitting takes a
bounded sample of labelled documents, one text for each id, whose features are written once, cut into slices of buckets.  In each
slice document frequencies per class are counted, and the log ratio of both classes' smoothed frequencies scales each feature.
Logistic regression with an L2 penalty is fitted by a quasi-Newton method.  Its weights are always sums of the sample's own rows, so
it works on one coefficient for each sample document: a step multiplies the coefficients by the rows' inner products, a pass of
Spark in which each slice adds its share.  Neither features nor weights reach the driver before the last pass.
A fifth of the sample is kept back from this: on it, a slope and an offset of the log-odds are fitted,
so that a score of 0.5 is where both classes are as likely.  Scoring reads every whole text of every document.

Defined results: a null text is empty and gets the score of a text without any feature; a null id is never in the
training part and scores as held_out null-safe false; labels that are null do not train; several labels of one
document count as toxic if any is, and of an id with several texts the one with the smallest hash trains; repeated rows are kept, one result each; an empty table gives an empty result;
without labels of both classes nothing is learned: every score is almost 1 if all labels are toxic, else almost 0; a
very long text is scored whole, as a block of its own; extra columns are ignored, or kept where documents are
(one with the score column's name too).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm.common import MULTIPLIERS, cut, free_name, give_back, loads, lowered, small_batches, text_blocks

#: Most labelled documents that fitting takes, toxic and others; those with the smallest hash of their id.
SAMPLE_TOXIC, SAMPLE_OTHER = 4000, 8000
#: Parts that the sample's slices are dealt to: a step sends a number for each sample document from each of them to the driver.
SAMPLE_PARTS = 8
#: One sample document in so many sets the slope and offset of the log-odds.
KEPT_BACK = 5
#: Lengths of n-grams in bytes, and log2 of the number of hashed buckets.
ORDERS = (4, 5, 6, 7, 8)
BUCKET_BITS = 20
#: log2 of the buckets of a slice; a number of a sample document has what an int32 leaves beside it.
SLICE_BITS = 12
#: Bytes of sample texts whose features are made at a time: n-grams, buckets and sorted pairs take many times as much memory.
FEATURE_BYTES = 1 << 18
#: L2 penalty; most steps of fitting, the share of the first gradient at which it ends, and the steps that it remembers.
PENALTY, STEPS, ENOUGH, REMEMBERED = 3.0, 25, 2e-4, 4


@dataclass
class Model:
    """weight[bucket] is the log-odds that the n-gram's presence adds; bias is a featureless text's log-odds."""

    weight: np.ndarray
    bias: float


def distinct_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of every document of a block, each once, in the order of their last places."""
    view, n = loads(lowered(data)), int(offsets[-1])
    grams = []
    for k in ORDERS:
        gram = view[: max(0, n - k + 1)] & np.uint64((1 << (8 * k)) - 1)
        grams.append(((gram ^ (gram >> np.uint64(23))) * MULTIPLIERS[k] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    last = np.zeros(1 << BUCKET_BITS, np.int32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = np.concatenate([g[a : b - k + 1] for g, k in zip(grams, ORDERS, strict=True) if b - a >= k] or [np.zeros(0, np.int32)])
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place
        yield own[last[own] == place]


def _packed(keys: np.ndarray) -> bytes:
    """Ascending int32 numbers, as their count and compressed byte planes of their differences."""
    planes = np.diff(keys, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(keys).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(pa.decompress(packed[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of sample documents and each slice of buckets: the pairs (document's number, bucket within the slice)."""
    bounds = np.arange((1 << (BUCKET_BITS - SLICE_BITS)) + 1, dtype=np.int64) << 31
    for batch in batches:
        numbers = batch.column("number").to_numpy().astype(np.int64)
        for first, last, data, offsets in text_blocks(batch.column("text"), FEATURE_BYTES):
            found = list(distinct_buckets(data, offsets))
            bucket = np.concatenate(found).astype(np.int64)
            keys = bucket >> SLICE_BITS << 31 | np.repeat(numbers[first:last], [len(b) for b in found]) << SLICE_BITS | bucket & ((1 << SLICE_BITS) - 1)
            keys.sort()
            cuts = np.searchsorted(keys, bounds)
            filled = np.flatnonzero(np.diff(cuts))
            chunks = [_packed(keys[cuts[i] : cuts[i + 1]] - bounds[i]) for i in filled.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(chunks, pa.binary())], names=["slice", "chunk"])
    give_back()


def _slices(label: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A slice's pairs of all documents, and the square of each bucket's scale; label is 0, 1, or -1 where a document does not train."""

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [int((label == c).sum()) for c in (0, 1)]
        for batch in batches:
            for number, chunks in zip(batch.column("slice").to_pylist(), batch.column("chunks"), strict=True):
                keys = np.sort(np.concatenate([_unpacked(c) for c in chunks.as_py()]))
                doc, bucket = keys >> SLICE_BITS, keys & ((1 << SLICE_BITS) - 1)
                counts = [np.bincount(bucket[label[doc] == c], minlength=1 << SLICE_BITS) for c in (0, 1)]
                ratio = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
                squares = np.where(counts[0] + counts[1] > 0, ratio * ratio, 0.0).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([_packed(keys)], pa.binary()), pa.array([squares.tobytes()], pa.binary())], names=["slice", "pairs", "squares"])
        give_back()

    return slices


def _summed(batches: Iterable[pa.RecordBatch], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every slice: its number, the weights of its buckets in the sum of the documents' rows times `rows`, and its pairs."""
    for batch in batches:
        for number, packed, squares in zip(*(batch.column(c) for c in ("slice", "pairs", "squares")), strict=True):
            keys = _unpacked(packed.as_py())
            doc, bucket = keys >> SLICE_BITS, keys & ((1 << SLICE_BITS) - 1)
            yield number.as_py(), np.frombuffer(squares.as_py(), "<f4") * np.bincount(bucket, rows[doc], minlength=1 << SLICE_BITS), doc, bucket


def _products(rows: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the slices of a part add to the inner products of every document's row with the sum of rows."""

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rows))
        for _, weight, doc, bucket in _summed(batches, rows):
            total += np.bincount(doc, weight[bucket], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["total"])
        give_back()

    return products


def _weights(rows: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, weight, _, _ in _summed(batches, rows):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([weight.astype("<f4").tobytes()], pa.binary())], names=["slice", "weight"])
        give_back()

    return weights


def calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make log-odds of known labels the likeliest; (1, 0) without labels of both classes, or a falling slope.

    Labels are smoothed by one document of each class, so that classes which the odds part wholly have finite ones.
    """
    if not y.any() or y.all():
        return 1.0, 0.0
    order = np.lexsort((y, odds))
    odds, y = odds[order], y[order]
    goal, scale = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)), float(np.abs(odds).max()) or 1.0

    def loss_of(v: np.ndarray) -> tuple[float, np.ndarray]:
        at = v[0] * odds / scale + v[1]
        wrong = 1 / (1 + np.exp(-np.clip(at, -500, 500))) - goal
        return float((np.logaddexp(0, at) - goal * at).mean()), np.array([float((wrong * odds / scale).mean()), float(wrong.mean())])

    slope, offset = minimise(loss_of, np.array([1.0, 0.0]), 200, 1e-8)
    return (float(slope) / scale, float(offset)) if slope > 0 else (1.0, 0.0)


def minimise(loss_of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = STEPS, enough: float = ENOUGH, inner: Callable[[np.ndarray, np.ndarray], float] = np.dot) -> np.ndarray:
    """The least of a smooth convex function, by L-BFGS: directions from the last steps, halved until the loss falls enough.

    inner is the inner product that gradients are taken in.
    """
    x = start
    loss, gradient = loss_of(x)
    first, pairs = max(0.0, float(inner(gradient, gradient))) ** 0.5, []
    for _ in range(steps):
        if max(0.0, float(inner(gradient, gradient))) ** 0.5 <= enough * first:
            break
        way, alphas = -gradient, []
        for s, y, bend in reversed(pairs):
            alphas.append(float(inner(s, way)) / bend)
            way = way - alphas[-1] * y
        way = way * (pairs[-1][2] / float(inner(pairs[-1][1], pairs[-1][1])) if pairs else min(1.0, 1 / max(first, 1e-12)))
        for (s, y, bend), alpha in zip(pairs, reversed(alphas), strict=True):
            way = way + (alpha - float(inner(y, way)) / bend) * s
        slope, size = float(inner(gradient, way)), 1.0
        for _ in range(20):
            new = x + size * way
            new_loss, new_gradient = loss_of(new)
            if new_loss <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_gradient - gradient
        if (bend := float(inner(s, y))) > 1e-12:
            pairs = [*pairs[-REMEMBERED + 1 :], (s, y, bend)]
        x, loss, gradient = new, new_loss, new_gradient
    return x


def training_part(doc_id: Column) -> Column:
    """True for ids that labels may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER) -> DataFrame:
    """doc_id, number (from 0, each its own), toxic, text of the bounded training sample: one text for each id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & training_part(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(other))
    # at most SAMPLE_TOXIC + SAMPLE_OTHER ids and labels, numbered and sent to all
    numbered = sample.withColumn("number", F.row_number().over(Window.orderBy("toxic", *order)) - 1)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(numbered), "doc_id")
    return found.groupBy("doc_id", "number", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER, kept_back: int = KEPT_BACK) -> Model:
    """Fit on the bounded sample; what reaches the driver is some numbers for each sample document, and at last one weight for each bucket.

    kept_back: one document in so many sets the slope and the offset (0: none does, and the fit's own odds stay).
    """
    if toxic + other > 1 << (31 - SLICE_BITS):
        raise ValueError(f"a sample has at most {1 << (31 - SLICE_BITS)} documents")
    back = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(kept_back)) == 0 if kept_back else F.lit(False)
    texts = cut(labelled_sample(small_batches(docs), labels, toxic, other).withColumn("back", back))
    rows = texts.select("number", "toxic", "back").collect()  # the bounded sample's labels
    size = max((r["number"] for r in rows), default=-1) + 1
    label, held = np.full(size, -1), np.full(size, -1)
    for r in rows:
        (held if r["back"] else label)[r["number"]] = r["toxic"]
    n = [int((label == c).sum()) for c in (0, 1)]
    if not n[0] or not n[1]:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 30.0 if n[1] else -30.0)
    chunks = texts.select("number", "text").mapInArrow(_features, "slice int, chunk binary").repartition(SAMPLE_PARTS, "slice")
    by_slice = chunks.groupBy("slice").agg(F.collect_list("chunk").alias("chunks")).coalesce(SAMPLE_PARTS)
    slices = cut(by_slice.mapInArrow(_slices(label), "slice int, pairs binary, squares binary"))
    train, total = label >= 0, sum(n)
    y = label[train]

    def inner(a: np.ndarray, b: np.ndarray) -> float:
        """Of points that hold a coefficient for each row, the inner products of their sum with each row, and the bias."""
        return float(a[:size] @ b[size : 2 * size] + a[-1] * b[-1])

    def loss_of(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and gradient, as a point like x."""
        odds, wrong, products = x[size : 2 * size][train] + x[-1], np.zeros(size), np.zeros(size)
        wrong[train] = 1 / (1 + np.exp(-np.clip(odds, -500, 500))) - y
        for row in slices.mapInArrow(_products(wrong), "total binary").collect():  # SAMPLE_PARTS rows
            products += np.frombuffer(row["total"], "<f8")
        loss = PENALTY / 2 * float(x[:size] @ x[size : 2 * size]) + float((np.logaddexp(0, odds) - y * odds).sum())
        return loss / total, np.concatenate([PENALTY * x[:size] + wrong, PENALTY * x[size : 2 * size] + products, [wrong.sum()]]) / total

    x = minimise(loss_of, np.append(np.zeros(2 * size), np.log((n[1] + 1) / (n[0] + 1))), inner=inner)
    weight, bias, kept = np.zeros((1 << (BUCKET_BITS - SLICE_BITS), 1 << SLICE_BITS), np.float32), float(x[-1]), held >= 0
    slope, offset = calibrated(x[size : 2 * size][kept] + bias, held[kept].astype(float))
    for row in slices.mapInArrow(_weights(slope * x[:size]), "slice int, weight binary").toLocalIterator():  # a weight for each bucket
        weight[row["slice"]] = np.frombuffer(row["weight"], "<f4")
    return Model(weight.ravel(), slope * bias + offset)


def _score(model: Model, name: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.weight.astype(np.float64)
        for batch in batches:
            odds = [float(weight[b].sum()) + model.bias for _, _, data, offsets in text_blocks(batch.column("text")) for b in distinct_buckets(data, offsets)]
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(np.array(odds, float), -700, 700)))))
        give_back()

    return score


def score_texts(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """docs with a score from 0 to 1 in a new column; the text column alone is read for it."""
    small_batches(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(model, name), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels), "score")
    held_out = F.coalesce(~training_part(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, all their columns."""
    own = free_name(docs, "__score")
    return score_texts(docs, fit(docs, labels), own).filter(F.col(own) < 0.5).drop(own)
