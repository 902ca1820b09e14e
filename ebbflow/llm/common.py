"""Shared pieces of the training-data operators: sessions, text buffers and word hashes.

The text helpers work on Arrow string columns without making Python strings: a batch is one byte buffer plus
document offsets, and words, shingles and n-grams are numpy arrays over it.  Large batches are cut into blocks of
whole documents so that the arrays of one block stay small; one very long document is a block of its own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of numpy work takes (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20

#: Odd 64-bit multipliers of the word and shingle hashes: successive steps of a fixed linear congruence.
MULTIPLIERS = np.array(
    [(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5 + 0xD1B54A32D192ED03 * i * 2) % (1 << 64) | 1 for i in range(1, 33)],
    dtype=np.uint64,
)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session that names none (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ebbflow-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches of its session held to `rows` rows: a batch of long texts is copied several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, rows)
    return df


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and shares the executor with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not hold, in any case: an operator's own column beside those of its input."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def text_blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first, last, data, offsets) for blocks of whole documents; nulls are empty texts.

    data is a uint8 array with 8 bytes of zero padding after the text; offsets are relative to it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
        last = min(last, len(column))
        part = np.zeros(offsets[last] - offsets[first] + 8, np.uint8)
        part[:-8] = data[offsets[first] : offsets[last]]
        yield first, last, part, offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as little-endian 64-bit integers; data has 8 bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ that never cross documents, and each document's first word (n+1)."""
    n = int(offsets[-1])
    inside = ~_SPACE[data[:n]]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIERS[0]
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIERS[1]
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, 8 bytes at a time; each seed is another function."""
    view, left = loads(data), ends - starts
    h = left.astype(np.uint64) * MULTIPLIERS[2] + MULTIPLIERS[4] * np.uint64(seed)
    at, live = starts.copy(), None
    while True:
        chunk = view[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ chunk)
            live = np.flatnonzero(left > 8)
            at, left = starts[live] + 8, left[live] - 8
        else:
            h[live] = mix(h[live] * MULTIPLIERS[3] ^ chunk)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        if not len(live):
            return h


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a document, and each document's first run (n+1)."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h += words[k : n - size + 1 + k] * MULTIPLIERS[8 + k]
    room = np.maximum(np.diff(first) - size + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(room)))
    at = np.repeat(first[:-1] - bounds[:-1], room) + np.arange(bounds[-1])
    return mix(h[at]), bounds


def equal_spans(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether spans a and b hold the same bytes, pair by pair."""
    view = loads(data)
    same = (a_end - a) == (b_end - b)
    live, left, k = np.flatnonzero(same), (a_end - a)[same], 0
    while len(live):
        mask = _MASKS[np.minimum(left, 8)]
        differ = (view[a[live] + k] & mask) != (view[b[live] + k] & mask)
        same[live[differ]] = False
        more = ~differ & (left > 8)
        live, left, k = live[more], left[more] - 8, k + 8
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one index for each distinct span, number of the distinct span of every span); compared byte by byte."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    key = np.sort((span_hashes(data, starts, ends) & ~low) | np.arange(n, dtype=np.uint64))
    order = (key & low).astype(np.int64)
    new = np.concatenate(([True], (key[1:] & ~low) != (key[:-1] & ~low)))
    first = order[new]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    held = first[number]
    odd = np.flatnonzero(~equal_spans(data, starts, ends, starts[held], ends[held]))  # hashes met: spans of their own
    number[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), number


def ragged(parts: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate parts[bounds[w]:bounds[w + 1]] for every w of wanted; also the bounds of the result."""
    size = (bounds[1:] - bounds[:-1])[wanted]
    out = np.concatenate(([0], np.cumsum(size)))
    return parts[np.repeat(bounds[:-1][wanted] - out[:-1], size) + np.arange(out[-1])], out


class Memory:
    """A bounded memory in two generations: what was asked for lately stays, results never depend on it."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, keys: list, compute) -> list:
        """Values of distinct keys; compute(list of unknown keys) gives theirs."""
        young, old = self.young, self.old
        unknown = [k for k in keys if k not in young and k not in old]
        fresh = dict(zip(unknown, compute(unknown), strict=True)) if unknown else {}
        out = []
        for k in keys:
            v = young.get(k)
            if v is None:
                v = fresh[k] if k in fresh else old[k]
                young[k] = v
            out.append(v)
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


#: A key with more than one row in so many is joined by itself: there are fewer such keys than this number.
HOT_SHARE = 1000


def join_split(rows: DataFrame, facts: DataFrame, key: str, n: str, share: int = HOT_SHARE) -> DataFrame:
    """rows beside the facts of their key (null meets null), however many rows a key has; every row stays.

    facts: one row for each key that rows hold, with the number n of the key's rows.  Keys with more than 1/share of all rows are
    fewer than share, so they and their facts are broadcast; the others are dealt by their key.
    """
    facts = cut(facts)
    total = facts.agg(F.sum(n)).first()[0] or 0
    own, other = free_name(rows, "hot__"), [f"`{c}`" for c in facts.columns if c not in (key, n)]
    is_hot = F.col(f"`{n}`") * share > total
    hot = facts.filter(is_hot).select(F.col(f"`{key}`").alias("key__"), F.lit(True).alias(own), *other)
    cold = facts.filter(~is_hot).select(F.col(f"`{key}`").alias("key__"), *other)
    names = [f"`{c}`" for c in rows.columns]
    met = rows.join(F.broadcast(hot), F.col(f"`{key}`").eqNullSafe(F.col("key__")), "left")
    known = met.filter(f"`{own}`").select(*names, *other)
    rest = met.filter(F.col(own).isNull()).select(*names)
    return known.unionByName(rest.join(cold, F.col(f"`{key}`").eqNullSafe(F.col("key__")), "left").select(*names, *other))
