"""Vector code compression: product quantisation by Lloyd rounds that move only what changed.

Component x becomes floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a
codebook of its own.  A round assigns every part to its nearest entry and writes each vector with its code and the code of
the round before.  Entries' sums and counts are running integers: only parts whose assignment changed contribute, plus to
their new entry and minus to their old one, summed within a task first, so that a task sends one row for each
entry it touches at most and a settled round sends next to nothing.  Assignments and sums are Parquet in the
shared folder: a lost executor makes its part of a round again from the round before.

What reaches the driver is the codebooks and their sums (parts x entries rows, whatever the table), and codebooks are
all that goes to the tasks beside the vectors.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part; repeated rows are kept, one
code each, and count as often in the sums; vectors of different lengths count as padded with zeros up to the
smallest multiple of the number of parts that holds the longest; the first codebook is that of the smallest ids, null ids
last and equal ids by their components; with fewer vectors than entries there are so many entries; an empty table gives an
empty result; extra columns are ignored.  Components of any size are counted exactly; an error that does not fit in
64 bits fails the query.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm.common import join_split, shared_folder

#: The largest width x (2 x component)^2 that 64-bit arithmetic takes, with room to sum parts; beyond it Python's integers count.
EXACT = 1 << 55
#: Distances that one step of an assignment holds.
BLOCK_DISTANCES = 1 << 21
CODED = "id long, label {label}, vector {vector}, last binary, code binary, error string"


def quantised(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """(vectors, width) integers: of 64 bits where all distances fit in them, else of any size."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        x = values.reshape(len(lengths), width)
    else:
        x = np.zeros((len(lengths), width))
        first = np.cumsum(lengths) - lengths
        x[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(first, lengths)] = values
    x = np.floor(x * float(scale))
    largest = float(np.abs(x).max()) if x.size else 0.0
    if width * (2 * largest) ** 2 < EXACT:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every part; ties go to the lower index."""
    if parts.dtype == object or entries.dtype == object or entries.size and parts.shape[1] * (2 * max(int(np.abs(entries).max()), int(np.abs(parts).max()) if parts.size else 0)) ** 2 >= EXACT:
        parts, entries = parts.astype(object), entries.astype(object)
    index, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    step = max(1, BLOCK_DISTANCES // max(1, entries.shape[0]))
    for a in range(0, len(parts), step):
        block = parts[a : a + step]
        distance = np.zeros((len(block), len(entries)), block.dtype)
        for d in range(block.shape[1]):
            off = block[:, d, None] - entries[None, :, d]
            distance += off * off
        at = distance.argmin(axis=1)
        index[a : a + step], least[a : a + step] = at, distance[np.arange(len(block)), at]
    return index, least


def _assign(codebooks: str, parts: int, scale: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign every part anew; the code so far becomes `last`."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(codebooks)
        size = books[0].shape[1]
        for batch in batches:
            x = quantised(batch.column("vector"), parts * size, scale)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                index, off = nearest(x[:, p * size : (p + 1) * size], book)
                code[:, p] = index
                error = error + off
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("vector"), batch.column("code"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([str(e) for e in error.tolist()], pa.string())],
                names=["id", "label", "vector", "last", "code", "error"],
            )

    return assign


def _contributions(parts: int, size: int, scale: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Plus and minus of the parts whose assignment changed, summed by entry within the task."""

    def contribute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            x = quantised(batch.column("vector"), parts * size, scale)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            last = batch.column("last").to_pylist()
            known = np.array([v is not None for v in last])
            old = np.frombuffer(b"".join(v if v is not None else bytes(parts) for v in last), np.uint8).reshape(-1, parts).astype(np.int64)
            for p in range(parts):
                moved = ~known | (old[:, p] != code[:, p])
                for sign, entry, at in ((1, code[:, p], np.flatnonzero(moved)), (-1, old[:, p], np.flatnonzero(moved & known))):
                    for e in np.unique(entry[at]).tolist():
                        own = x[at[entry[at] == e], p * size : (p + 1) * size]
                        total = sums.setdefault((p, e), [0] * (size + 1))
                        total[0] += sign * len(own)
                        for d, s in enumerate(own.sum(axis=0).tolist()):
                            total[d + 1] += sign * s
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in sums], pa.int32()), pa.array([e for _, e in sums], pa.int32()), pa.array([json.dumps(s) for s in sums.values()])], names=["part", "entry", "sums"]
            )

    return contribute


def _add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for batch in rows:
        for text in batch.column("sums").to_pylist():
            got = json.loads(text)
            total = [a + b for a, b in zip(total, got, strict=True)] if total else got
    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([json.dumps(total)])], names=["part", "entry", "sums"])


def _books(codebooks: str) -> list[np.ndarray]:
    """Codebooks from their JSON text; components of any size."""
    out = []
    for book in json.loads(codebooks):
        wide = any(abs(c) >= 1 << 40 for entry in book for c in entry)
        out.append(np.array(book, dtype=object if wide else np.int64).reshape(len(book), len(book[0])))
    return out


def digest(codebooks: list[list[list[int]]]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, vector of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.filter(v.isNotNull() & whole.eqNullSafe(True))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), (v if kept.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else v.cast("array<double>")).alias("vector"))


def fit(rows: DataFrame, folder: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows with their final codes and errors, final codebooks); the rounds are written to the folder."""
    spark = rows.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit in a byte")
    coded = CODED.format(**{c: rows.schema[c].dataType.simpleString() for c in ("label", "vector")})
    rows = rows.withColumn("code", F.lit(None).cast("binary"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], coded), []
    size = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # bounded by `entries`
    seeds = quantised(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts * size, scale)
    books = [seeds[:, p * size : (p + 1) * size].tolist() for p in range(parts)]
    sums = {(p, e): [0] * (size + 1) for p in range(parts) for e in range(len(first))}
    for i in range(rounds + 1):
        rows.mapInArrow(_assign(json.dumps(books), parts, scale), coded).write.mode("overwrite").parquet(f"{folder}/round={i}")
        rows = spark.read.schema(coded).parquet(f"{folder}/round={i}")
        if i == rounds:
            return rows, books
        moved = rows.filter(~F.col("code").eqNullSafe(F.col("last"))).select("vector", "last", "code")
        summed = moved.mapInArrow(_contributions(parts, size, scale), "part int, entry int, sums string").groupBy("part", "entry").applyInArrow(_add, "part int, entry int, sums string")
        summed.write.mode("overwrite").parquet(f"{folder}/changes={i}")
        for r in spark.read.schema("part int, entry int, sums string").parquet(f"{folder}/changes={i}").collect():  # parts x entries rows at most
            sums[r["part"], r["entry"]] = [a + b for a, b in zip(sums[r["part"], r["entry"]], json.loads(r["sums"]), strict=True)]
        for (p, e), (n, *total) in sums.items():
            if n:
                books[p][e] = [s // n for s in total]
    raise AssertionError


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    kept = taking_part(vectors, id_col, vector_col, label_col)
    rows, books = fit(kept, shared_folder(vectors.sparkSession, "codes"), parts, entries, rounds, scale)
    too_large = F.raise_error(F.lit("an error does not fit in 64 bits"))
    coded = rows.select("id", "label", "code", F.when(F.length("error") > 19, too_large).otherwise(F.col("error").try_cast("decimal(38,0)")).alias("wide"))
    by_label = coded.groupBy("label").agg(F.sum("wide").cast("decimal(38,0)").alias("label_wide"), F.count("*").alias("label_rows"))
    out = join_split(coded, by_label, "label", "label_rows")
    whole = lambda c: F.when(F.col(c) > (1 << 63) - 1, too_large).otherwise(F.col(c).cast("long"))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), whole("wide").alias("error"), whole("label_wide").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def decode(rows: DataFrame, codebooks: list[list[list[int]]], scale: int = 256) -> DataFrame:
    """rows with a column `decoded`: the vector that a code (binary) stands for, in the vectors' own scale."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.ArrayType(T.DoubleType()))])

    def lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if c is None else [v / scale for p, e in enumerate(c) for v in codebooks[p][e]] for c in batch.column("code").to_pylist()]
            yield batch.append_column("decoded", pa.array(vectors, pa.list_(pa.float64())))

    return rows.mapInArrow(lookup, schema)
