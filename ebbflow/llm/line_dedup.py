"""Line deduplication: lines that many documents hold are dropped, by bitmaps instead of texts.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys travel as 128-bit hashes, one row for each key
of a document with the places where it holds it, and are range-partitioned with a secondary order by document and
place.  A pass over each sorted partition streams a key's occurrences, first ones first, and holds a run only until enough
documents have been seen.  The range bounds may cut a key that very many documents hold into several partitions: a run
that its partition cannot decide alone, or that might have begun in the one before, meets its other parts in a
second, small grouping of at most a few rows for each bound.  What comes back for a document is a compressed bitmap of the
lines to keep; texts are read again only where bitmaps are applied.

Defined results: a null or empty text is one empty line; a key without a code point is never dropped; rows that repeat an id and
a text are one document, each text of an id, or of rows without an id, is a document of its own; bitmaps end with the
byte of the last dropped line, and lines beyond stay; "first" keeps the first occurrence by id (null ids first), text hash
and place; an empty table gives an empty result; texts are split whole, however long; extra columns are ignored, or
kept where documents are, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import _SPACE, cut, free_name, lowered, small_batches, span_hashes, text_blocks

KEY = ["h1", "h2", "doc_id", "version"]
DROPPED, OPEN, COUNTED = 0, 1, 2


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines' keys, and each line's document and place in it; empty keys have equal ends."""
    n = int(offsets[-1])
    breaks = np.flatnonzero(data[:n] == 10)
    doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    held = np.bincount(doc_of_break, minlength=len(offsets) - 1) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), held)
    first = np.cumsum(held) - held
    place = np.arange(len(starts)) - np.repeat(first, held)
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first + held - 1] = offsets[1:]
    solid = np.flatnonzero(~_SPACE[data[:n]])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    a, b = starts.copy(), starts.copy()
    a[full], b[full] = solid[lo[full]], solid[hi[full] - 1] + 1
    return a, b, doc, place


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a document: its hash, the document, and the key's places (32-bit integers)."""
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column("text")):
            low = lowered(data)
            a, b, doc, place = line_spans(low, offsets)
            full = b > a
            a, b, doc, place = a[full], b[full], doc[full], place[full]
            if not len(a):
                continue
            h1, h2 = (span_hashes(low, a, b, seed).view(np.int64) for seed in (0, 1))
            order = np.lexsort((place, doc, h2, h1))
            h1, h2, doc, place = h1[order], h2[order], doc[order], place[order].astype("<i4")
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])))
            at = np.flatnonzero(new)
            places = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(place)) * 4).astype("<i4").tobytes()), pa.py_buffer(place.tobytes())])
            own = pa.array(doc[at] + first)
            yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), batch.column("doc_id").take(own), batch.column("version").take(own), places], names=[*KEY, "places"])


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; a null differs from all but a null."""
    if len(column) < 2:
        return np.zeros(0, bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    nulls = pc.and_(pc.is_null(a), pc.is_null(b))
    return ~pc.or_(same, nulls).to_numpy(zero_copy_only=False)


def _after_first(places: bytes) -> bytes:
    return places[4:]


def _decide(least: int, keep_first: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream a sorted partition: rows of keys in `least` documents or more as DROPPED, runs at its bounds as OPEN and COUNTED."""

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the last run, while they are fewer than `least` documents
        known: tuple[int, int] | None = None  # the last run, once it has been seen in enough documents
        head = True  # no run of this partition has ended yet

        def rows(part: pa.Table, state: int, mask: np.ndarray | None = None) -> pa.Table:
            part = part if mask is None else part.filter(pa.array(mask))
            return part.append_column("state", pa.array(np.full(len(part), state, np.int32)))

        def opened(part: pa.Table, counted: bool) -> Iterator[pa.Table]:
            """A run at a bound: what others must know of it."""
            if not counted:
                yield rows(part, OPEN)
                return
            if keep_first:
                yield rows(part.slice(0, 1), OPEN)
                part = part.slice(1)
            else:
                yield rows(part.slice(0, 1), COUNTED)
            yield rows(part, DROPPED)
            if keep_first:
                yield rows(part.slice(0, 1), COUNTED)

        def step(part: pa.Table, last: bool) -> Iterator[pa.Table]:
            nonlocal held, known, head
            if known is not None:  # goes on with a run that is known to be dropped
                h = (part["h1"].to_numpy() != known[0]) | (part["h2"].to_numpy() != known[1])
                own = int(h.argmax()) if h.any() else len(part)
                if own:
                    yield rows(part.slice(0, own), DROPPED)
                part = part.slice(own)
                if len(part):
                    known, head = None, False
            if held is not None:
                part, held = pa.concat_tables([held, part]), None
            part = part.combine_chunks()
            if not len(part):
                return
            column = lambda n: part[n].chunk(0)
            run = _differs(column("h1")) | _differs(column("h2"))
            new = np.concatenate(([True], run | _differs(column("doc_id")) | _differs(column("version"))))
            if not new.all():  # repeated rows of one document
                part, run = part.filter(pa.array(new)).combine_chunks(), run[np.flatnonzero(new)[1:] - 1]
            at = np.concatenate(([0], np.flatnonzero(run) + 1, [len(part)]))
            size = np.diff(at)
            inner = slice(1 if head else 0, len(size) if last else len(size) - 1)
            drop = np.zeros(len(size), bool)
            drop[inner] = (size >= least)[inner]
            if last and len(size) and not (head and len(size) == 1):
                drop[-1] = False  # the last run of the partition may go on in the next one
            begin = np.zeros(len(part), bool)
            begin[at[:-1]] = keep_first
            mask = np.repeat(drop, size)
            if (mask & ~begin).any():
                yield rows(part, DROPPED, mask & ~begin)
            if keep_first and (mask & begin).any():
                firsts = rows(part, DROPPED, mask & begin)
                later = pa.array([_after_first(p) for p in firsts["places"].to_pylist()], pa.binary())
                yield firsts.set_column(firsts.schema.get_field_index("places"), "places", later)
            if head and len(size) > 1:
                yield from opened(part.slice(0, int(size[0])), size[0] >= least)
                head = False
            tail = part.slice(int(at[-2]))
            if last:
                yield from opened(tail, size[-1] >= least)
            elif size[-1] >= least:
                known = (tail["h1"][0].as_py(), tail["h2"][0].as_py())
                yield from opened(tail, True)
            else:
                held = tail

        def out(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield from part.combine_chunks().to_batches()

        for batch in batches:
            yield from out(step(pa.Table.from_batches([batch]), False))
        if held is not None:
            rest, held = held, None
            yield from out(step(rest, True))

    return decide


def _meet(least: int, keep_first: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Decide a run that range bounds have cut: its rows from partitions that could not decide alone."""

    def meet(key: tuple, run: pa.Table) -> pa.Table:
        state = run["state"].to_numpy()
        if len(run) and (state == COUNTED).any() or int((state == OPEN).sum()) >= least:
            part = run.filter(pa.array(state == OPEN)).sort_by([("doc_id", "ascending"), ("version", "ascending")]) if keep_first else run.filter(pa.array(state == OPEN))
            places = part["places"].to_pylist()
            if keep_first and places:
                nulls = pc.is_null(part["doc_id"]).to_numpy(zero_copy_only=False)
                first = int(np.flatnonzero(nulls)[0]) if nulls.any() else 0
                places[first] = _after_first(places[first])
            return pa.table({"doc_id": part["doc_id"], "version": part["version"], "places": pa.array(places, pa.binary())})
        return run.slice(0, 0).select(["doc_id", "version", "places"])

    return meet


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed bits of the lines to keep, up to the last one that goes."""
    for batch in batches:
        count, bits = [], []
        for row in batch.column("rows").to_pylist():
            places = np.frombuffer(b"".join(row), "<i4")
            keep = np.ones((int(places.max()) // 8 + 1) * 8, bool)  # whole bytes
            keep[places] = False
            count.append(int((~keep).sum()))
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(count, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "version", "n_dropped", "keep"])


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    """The lines of a text that its bitmap keeps."""
    lines = text.split("\n")
    if not keep:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool).tolist()
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def _text(docs: DataFrame):
    return F.coalesce(F.col("text"), F.lit(""))


def keep_bitmaps(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, version (hash of the text), n_dropped, keep (compressed bitmap) of every document that loses a line.

    A key in `least` documents or more loses all its lines, or with keep_first all but its first one.
    """
    small_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = f"h1 long, h2 long, doc_id {kind}, version long, places binary"
    versions = docs.select("doc_id", F.xxhash64(_text(docs)).alias("version"), _text(docs).alias("text"))
    rows = versions.mapInArrow(_keys, keyed)
    streamed = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(_decide(least, keep_first), f"{keyed}, state int")
    streamed = cut(streamed)
    short = f"doc_id {kind}, version long, places binary"
    bounds = streamed.filter(F.col("state") != DROPPED).groupBy("h1", "h2").applyInArrow(_meet(least, keep_first), short)
    gone = streamed.filter(F.col("state") == DROPPED).select("doc_id", "version", "places").unionByName(bounds).filter(F.length("places") > 0)
    listed = gone.groupBy("doc_id", "version").agg(F.collect_list("places").alias("rows"))  # as long as a document has lines
    return listed.mapInArrow(_bitmaps, f"doc_id {kind}, version long, n_dropped long, keep binary")


def _beside(docs: DataFrame, least: int, keep_first: bool, *names: str) -> DataFrame:
    """docs with version, n_dropped and keep under the given names."""
    version, dropped, keep = names
    own = docs.withColumn(version, F.xxhash64(_text(docs)))
    its_id, its_version = free_name(own, "its_id"), free_name(own, "its_version")
    bits = keep_bitmaps(docs, least, keep_first).select(F.col("doc_id").alias(its_id), F.col("version").alias(its_version), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))
    met = own.join(bits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(version) == F.col(its_version)), "left")
    return met.select(*[f"`{c}`" for c in docs.columns], dropped, keep)


def line_digests(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            kept = [t if k is None else "\n".join(kept_lines(t, k)) for t, k in zip(texts, batch.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t.count("\n") + 1 for t in texts], pa.int64()), pc.fill_null(batch.column("n_dropped"), 0), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept])],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _beside(docs, least, keep_first, "version", "n_dropped", "keep").mapInArrow(digest, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """The documents without the dropped lines; all columns and all rows stay, a null text stays null."""
    names = [free_name(docs, n) for n in ("version__", "n_dropped__", "keep__")]

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            bits = batch.column(batch.schema.get_field_index(names[2])).to_pylist()
            texts = [t if t is None or k is None else "\n".join(kept_lines(t, k)) for t, k in zip(batch.column(at).to_pylist(), bits, strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select([n for n in batch.schema.names if n not in names])

    return _beside(docs, least, keep_first, *names).mapInArrow(cleaned, docs.schema)
