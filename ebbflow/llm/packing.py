"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document's cost is estimated as linear in its tokens plus quadratic (attention within the document).  Inside a
packing block (the documents of one task, up to a bounded number of tokens), whole sequences are cut off long
documents first; the remaining pieces, by descending cost, each go to the lowest-cost sequence that still has room
for them.  A piece that fits nowhere is cut at the largest room left.  A block's capacity equals its tokens: full
sequences, and for the rest sequences of decreasing powers of two, so that no padding is left.

Defined results: a null or empty text is the one token of the document's end; a null id keeps its own pieces;
repeated rows are documents of their own; an empty table gives an empty result; extra columns are ignored (or kept
by `pack_documents(keep=...)`).  Very long texts are cut into pieces; each token is in exactly one piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ebbflow.llm.common import Memory, distinct_spans, ragged, text_blocks

#: Tokens of a sequence, and of a packing block at most (one longer document is cut over several blocks' worth).
SEQUENCE = 2048
BLOCK_TOKENS = 1 << 22
#: cost(n) = LINEAR * n + QUADRATIC * n * n
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Text segments of a generation that a worker remembers; results do not depend on it.
REMEMBERED = 300_000
#: Bytes of text tokenised at a time.
TEXT_BLOCK = 4 << 20

# First bytes of the characters among which Unicode has its white space beyond ASCII: a space beside one is no cut.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_GRAPH[0x80:] = True


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments that byte-level BPE encodes one by one: documents, and spaces between two visible characters."""
    n = int(offsets[-1])
    cuts = np.flatnonzero(data[:n] == 0x20)
    cuts = cuts[(cuts > 2) & (cuts < n - 1)]
    cuts = cuts[_GRAPH[data[cuts - 1]] & _GRAPH[data[cuts + 1]] & ~_WIDE_SPACE[data[cuts + 1]] & (data[cuts - 2] != 0xC2) & ~_WIDE_SPACE[data[cuts - 3]]]
    doc = np.searchsorted(offsets, cuts, "right") - 1
    cuts = cuts[(cuts > offsets[doc] + 2) & (cuts < offsets[doc + 1] - 1)]
    return np.sort(np.concatenate((offsets[:-1][np.diff(offsets) > 0], cuts)))


class Encoder:
    """ids of whole texts by a byte-level BPE tokenizer file, encoding each distinct segment of a block once.

    The tokenizer's pattern starts a new piece at a single space between two visible characters, so segments cut
    there have the ids that they have in the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(REMEMBERED)

    def _fresh(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of documents and the documents' bounds in them."""
        starts = segments(data, offsets)
        ends = np.append(starts[1:], offsets[-1])[: len(starts)]
        chosen, number = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        parts = self.memory.get([raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)], self._fresh)
        bounds = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)))
        ids, at = ragged(np.frombuffer(b"".join(parts), "<u4"), bounds, number)
        return ids, at[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> np.ndarray:
        """ids of one text."""
        return next((self.block(data, offsets)[0] for _, _, data, offsets in text_blocks(pa.array([text]))), np.zeros(0, "<u4"))


def capacities(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Room of each sequence of a block: full ones, then decreasing powers of two for the rest."""
    rest = total % sequence
    return [sequence] * (total // sequence) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence number, offset) of every piece of one block's documents."""
    rooms, out, number = capacities(sum(lengths), sequence), [], 0
    pieces = []  # (-cost, document, start, length)
    cost = lambda n: linear * n + quadratic * n * n
    for d, n in enumerate(lengths):
        whole = n // sequence
        for i in range(whole):
            out.append((d, i * sequence, sequence, number, 0))
            number += 1
        if n % sequence:
            pieces.append((-cost(n % sequence), d, whole * sequence, n % sequence))
    heapify(pieces)
    room = np.array(rooms[number:], np.int64)
    load, filled = np.zeros(len(room)), np.zeros(len(room), np.int64)
    load[room < sequence] = cost(sequence)  # short sequences are filled last
    while pieces:
        _, d, start, n = heappop(pieces)
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s, take = int(fits[np.argmin(load[fits])]), n
        else:
            s = int(np.lexsort((load, -room))[0])
            take = int(room[s])
            heappush(pieces, (-cost(n - take), d, start + take, n - take))
        out.append((d, start, take, number + s, int(filled[s])))
        load[s] += cost(take)
        filled[s] += take
        room[s] -= take
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_tasks(path: str, end: int, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(docs: list[tuple[int | None, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        placed = pack([len(ids) for _, ids in docs])
        cols: list[list] = [[] for _ in range(7)]
        parts = []
        for d, start, length, number, offset in placed:
            doc_id, ids = docs[d]
            part = ids[start : start + length].tobytes()
            for c, v in zip(cols, (doc_id, start, length, zlib.crc32(part), len(ids), base + number, offset), strict=True):
                c.append(v)
            parts.append(part)
        arrays = [pa.array(c, pa.int64()) for c in cols]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array(parts, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names), base + 1 + max((p[3] for p in placed), default=-1)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        base, docs, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, data, offsets in text_blocks(batch.column("text"), TEXT_BLOCK):
                all_ids, bounds = encoder.block(data, offsets)
                for i in range(last - first):
                    ids = np.append(all_ids[bounds[i] : bounds[i + 1]], np.uint32(end)).astype("<u4")
                    if docs and held + len(ids) > BLOCK_TOKENS:
                        out, base = rows(docs, base)
                        yield out
                        docs, held = [], 0
                    docs.append((doc_ids[first + i], ids))
                    held += len(ids)
        if docs:
            yield rows(docs, base)[0]

    return work


def pack_documents(docs: DataFrame, tokenizer_path: str, end: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece; sequence_id is the task's number and the sequence's number in it.

    Nothing is shuffled: each task packs what it reads, so a retried task gives the same pieces again.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack_tasks(tokenizer_path, end, with_ids), PIECES + (", ids binary" if with_ids else ""))
