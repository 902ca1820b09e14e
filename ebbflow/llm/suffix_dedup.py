"""Exact substring deduplication with longest-previous-factor arrays over a distributed suffix order.

A byte is removed when a string of `length` bytes that covers it also starts in a document with a smaller id.  No
task sees all suffixes.  Every window of `length` bytes is dealt by the smallest hash of the k-grams inside it, so
equal windows meet in one bucket wherever they stand, and neighbouring windows mostly travel together as one
context.  Four steps, each over bounded groups:

1. documents are dealt to chunks by id and text; a chunk sends each bucket the distinct minimal hashes it holds (8 bytes each,
   with a mark when several of its documents hold one, and about how often they do);
2. a bucket tells each chunk which of its hashes are held by several documents, and over how many buckets those are dealt
   that would fill one (a common k-gram in many different contexts);
3. a chunk sends the contexts of those hashes, or of the latter single windows dealt by their own hash, each distinct content
   once with its smallest document; the bucket
   builds the suffix order of all windows that occur twice or more, and the longest-previous-factor array over
   document order: previous and next smaller documents in suffix order, with the common prefix down to them;
4. the ranges found go back to the chunks, which apply them to all holders of the content.

A passage that a third of all documents hold is sent once by each chunk, not once by each document.

Defined results: a null text is empty; documents with a null id lose nothing and cause no removal; rows that repeat an id are
documents of that id (an equal id is not smaller); texts shorter than `length` lose nothing; matches never cross
documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import MULTIPLIERS, distinct_spans, equal_spans, give_back, loads, mix, ragged, small_batches, span_hashes

#: Bytes of the strings that count, and of the k-grams whose hashes deal windows.
LENGTH, GRAM = 50, 16
#: Bytes of text in a chunk, about, and the least number of chunks.
CHUNK_BYTES, LEAST_CHUNKS = 6 << 20, 64
#: Buckets for each chunk: what a bucket sorts at once is a part of what a chunk holds.
BUCKETS = 4
#: Window starts that one numpy step takes.
STEP = 1 << 18
#: Contexts of one minimal hash that a bucket takes; a hash with more is dealt to several buckets by whole windows.
HOT = 1 << 15
#: Bits beside a hash: whether several documents of the chunk hold it, and the logarithm of how often.
FREE_BITS = 6


def minimal_hashes(data: np.ndarray, n: int, a: int, b: int, length: int) -> np.ndarray:
    """For window starts a..b: the smallest hash of the k-grams inside; data has 8 bytes of padding after n."""
    width = length - GRAM + 1
    view = loads(data[a : min(b + length + 8, n + 8)])
    grams = b - a + width - 1
    h = (view[:grams] * MULTIPLIERS[4]) ^ (view[8 : grams + 8] * MULTIPLIERS[5] >> np.uint64(17))
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIERS[6]
    h >>= np.uint64(FREE_BITS)  # free for a mark and a count
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: b - a], h[width - size : width - size + b - a]) if width > size else h[: b - a]


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, end of starts, hash) of all maximal runs of windows with one minimal hash in one document."""
    n = int(offsets[-1])
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(step, offsets[1:], -1)
    valid = np.cumsum(step[:n], dtype=np.int32) == 0
    out = ([], [], [])
    for a in range(0, max(n - length + 1, 0), STEP):
        b = min(a + STEP, n - length + 1)
        m, ok = minimal_hashes(data, n, a, b, length), valid[a:b]
        change = np.ones(b - a, bool)
        change[1:] = (m[1:] != m[:-1]) | ~ok[:-1]
        first = np.flatnonzero(change & ok)
        stop = np.flatnonzero(np.append((change[1:] | ~ok[1:]), True) & ok) + 1
        for o, v in zip(out, (first + a, stop + a, m[first]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.uint64), strict=True))


def chunk_text(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, ids, data, offsets) of a chunk without null ids, in the order of ids and texts (a defined order)."""
    order = pc.sort_indices(table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")])
    table = table.take(order)
    text = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return table, table["doc_id"].to_numpy().astype(np.int64), data, offsets - offsets[0]


def _buckets(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(33)).astype(np.int64) % n_buckets


def _send(n_buckets: int, length: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def send(key: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table["doc_id"]))
        out_b, out_h = [], []
        if len(table):
            _, ids, data, offsets = chunk_text(table)
            start, _, h = runs(data, offsets, length)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], ids[np.searchsorted(offsets, start, "right") - 1][order]
            if len(h):
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                several = np.maximum.reduceat(owner, first) != np.minimum.reduceat(owner, first)
                often = np.log2(np.diff(np.append(first, len(h)))).astype(np.uint64)
                marked = h[first] << np.uint64(FREE_BITS) | np.minimum(often, np.uint64(31)) << np.uint64(1) | several.astype(np.uint64)
                bucket = _buckets(h[first], n_buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True])))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    out_b.append(int(bucket[order[a]]))
                    out_h.append(marked[order[a:b]].tobytes())
        give_back()
        return pa.table({"bucket": pa.array(out_b, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out_b), pa.int64()), "hashes": pa.array(out_h, pa.binary())})

    return send


def _shared(hot: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def shared(key: tuple, table: pa.Table) -> pa.Table:
        """For each chunk, sorted, those of its hashes that several documents hold, and over how many buckets each is dealt."""
        chunks = table["chunk"].to_numpy()
        parts = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
        marked = np.concatenate(parts)
        chunk = np.repeat(chunks, [len(p) for p in parts])
        order = np.argsort(marked >> np.uint64(FREE_BITS), kind="stable")
        marked, chunk = marked[order], chunk[order]
        h, mark, often = marked >> np.uint64(FREE_BITS), marked & np.uint64(1), np.left_shift(1, (marked >> np.uint64(1) & np.uint64(31)).astype(np.int64))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(first, len(h)))
        keep = np.repeat((size > 1) | (np.maximum.reduceat(mark, first) > 0), size)
        splits = np.repeat(1 + np.add.reduceat(often, first) // hot, size)[keep]
        h, chunk = h[keep], chunk[keep]
        order = np.argsort(chunk, kind="stable")
        h, chunk, splits = h[order], chunk[order], splits[order].astype("<i4")
        cut = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({"chunk": pa.array(chunk[cut[:-1]] if len(h) else [], pa.int64()), "payload": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), "splits": pa.array([splits[a:b].tobytes() for a, b in spans], pa.binary())})

    return shared


def holders(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(representative run, distinct content's number of every run, id of every run's document).

    The representative of a content is its first run of the smallest id; ids ascend along the chunk.
    """
    owner = ids[np.searchsorted(offsets, start, "right") - 1]
    chosen, number = distinct_spans(data, start, stop + length - 1)
    first = np.full(len(chosen), len(start))
    np.minimum.at(first, number, np.arange(len(start)))
    return first, number, owner


CONTEXTS = "bucket long, chunk long, run binary, shift binary, owner binary, size binary, content binary"


def _contexts(n_buckets: int, length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def contexts(docs: pa.Table, shared: pa.Table) -> pa.Table:
        names = {n: pa.int64() if k == "long" else pa.binary() for n, k in (f.split(" ") for f in CONTEXTS.split(", "))}
        cols: dict[str, list] = {k: [] for k in names}
        docs = docs.filter(pc.is_valid(docs["doc_id"]))
        if len(docs) and len(shared):
            _, ids, data, offsets = chunk_text(docs)
            start, stop, h = runs(data, offsets, length)
            wanted, splits = np.concatenate([np.frombuffer(x, "<u8") for x in shared["payload"].to_pylist()]), np.concatenate([np.frombuffer(x, "<i4") for x in shared["splits"].to_pylist()])
            order = np.argsort(wanted)
            wanted, splits = wanted[order], splits[order]
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            run = np.flatnonzero(wanted[at] == h)
            first, _, owner = holders(data, offsets, ids, start[run], stop[run], length)
            owner, run = owner[first], run[first]
            # a context is sent whole, or window by window if its hash is dealt to several buckets
            split = splits[at[run]]
            windows = np.where(split > 1, stop[run] - start[run], 1)
            of = np.repeat(np.arange(len(run)), windows)
            shift = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            run, owner, split = run[of], owner[of], split[of]
            begin = start[run] + shift
            end = np.where(split > 1, begin + length, stop[run] + length - 1)
            dealt, hot = h[run].copy(), np.flatnonzero(split > 1)
            dealt[hot] = mix(dealt[hot] * MULTIPLIERS[9] + mix(span_hashes(data, begin[hot], end[hot])) % split[hot].astype(np.uint64))
            bucket = _buckets(dealt, n_buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                pick = order[a:b]
                lo, size = begin[pick], end[pick] - begin[pick]
                to = np.concatenate(([0], np.cumsum(size)))
                content = data[np.repeat(lo - to[:-1], size) + np.arange(to[-1])]
                row = (int(bucket[pick[0]]), docs["chunk"][0].as_py(), *(x[pick].astype("<i8").tobytes() for x in (run, shift, owner)), size.astype("<i8").tobytes(), pa.compress(content.tobytes(), "zstd", asbytes=True))
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)
        give_back()
        return pa.table({k: pa.array(cols[k], t) for k, t in names.items()})

    return contexts


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `at` in the order of the suffixes' first `length` bytes, and where runs of equals begin (and the end).

    `at` lists suffix starts; equal suffixes stay in the order of the list.
    """
    view = loads(data)
    steps = range(0, length, 8)
    last = np.uint64((1 << (8 * ((length - 1) % 8 + 1))) - 1)
    word = lambda i, k: view[i + k] & last if k + 8 > length else view[i + k]
    h = np.zeros(len(at), np.uint64)
    for k in steps:
        h = (h ^ word(at, k)) * MULTIPLIERS[7]
        h ^= h >> np.uint64(29)
    low = np.uint64((1 << max(1, len(at).bit_length())) - 1)
    key = np.sort((mix(h) & ~low) | np.arange(len(at), dtype=np.uint64))
    order, top = (key & low).astype(np.int64), key & ~low
    new = np.concatenate(([True], top[1:] != top[:-1]))
    first = order[new][np.cumsum(new) - 1]
    if not equal_spans(data, at[order], at[order] + length, at[first], at[first] + length).all():  # hashes met
        order = np.lexsort([word(at, k).byteswap() for k in reversed(steps)])
        same = equal_spans(data, at[order[1:]], at[order[1:]] + length, at[order[:-1]], at[order[:-1]] + length)
        new = np.concatenate(([True], ~same))
    bounds = np.append(np.flatnonzero(new), len(order))
    return ragged(order, bounds, _by_bytes(data, at[order[bounds[:-1]]], length))


def _by_bytes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The order of distinct strings of `length` bytes: by eight bytes, and where those are equal by the next eight."""
    view, last = loads(data), np.uint64((1 << (8 * ((length - 1) % 8 + 1))) - 1)
    word = lambda i, k: (view[i + k] & last if k + 8 > length else view[i + k]).byteswap()
    first = word(at, 0)
    order = np.argsort(first, kind="stable")
    tied = np.concatenate(([False], first[order][1:] == first[order][:-1]))
    for k in range(8, length, 8):
        held = tied.copy()
        held[:-1] |= tied[1:]  # places in runs of strings that are equal so far
        place = np.flatnonzero(held)
        if not len(place):
            break
        run, own = np.cumsum(~tied[place]), word(at[order[place]], k)
        by = np.lexsort((own, run))
        order[place], own = order[place][by], own[by]
        same = np.concatenate(([False], (own[1:] == own[:-1]) & (run[1:] == run[:-1])))
        tied[place] = same
    return order


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, pair by pair, up to `length`."""
    view, out, live = loads(data), np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, length, 8):
        differ = view[a[live] + k] ^ view[b[live] + k]
        lowest = differ & (~differ + np.uint64(1))
        out[live] += np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        live = live[differ == 0]
    return np.minimum(out, length)


def nearest_smaller(owner: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Common prefix of each suffix with the previous suffix of a smaller owner, 0 where it is under `least`.

    common[i] is the common prefix of suffixes i - 1 and i.  Pointers jump over suffixes of no smaller owner, all at
    once, until they rest on a smaller one or the prefix falls under `least`.
    """
    n = len(owner)
    to, prefix = np.arange(n) - 1, common.copy()
    live = np.flatnonzero((to >= 0) & (prefix >= least))
    while len(live):
        live = live[owner[to[live]] >= owner[live]]
        via = to[live]
        prefix[live] = np.minimum(prefix[live], prefix[via])
        to[live] = to[via]
        ended = (to[live] < 0) | (prefix[live] < least)
        prefix[live[ended]] = 0
        live = live[~ended]
    prefix[(prefix < least) | (to < 0)] = 0
    return prefix


def longest_previous_factor(data: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each suffix start of `at`: its longest previous factor among smaller owners, capped at `length`.

    at must be in the order of owners, so that equal suffixes are.
    """
    out = np.zeros(len(at), np.int64)
    if len(at):
        order, bounds = suffix_order(data, at, length)
        common = np.full(len(order), length)
        heads = order[bounds[:-1]]
        common[bounds[:-1]] = np.concatenate(([0], common_prefix(data, at[heads[:-1]], at[heads[1:]], length)))
        who = owner[order]
        before = nearest_smaller(who, common)
        turned = np.concatenate(([0], common[::-1][:-1]))
        after = nearest_smaller(who[::-1], turned)[::-1]
        out[order] = np.maximum(before, after)
    return out


def _factors(length: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def factors(key: tuple, table: pa.Table) -> pa.Table:
        rows = [{k: np.frombuffer(r[k], "<i8") for k in ("run", "shift", "owner", "size")} | {"chunk": r["chunk"], "content": r["content"]} for r in table.to_pylist()]
        sizes = np.concatenate([r["size"] for r in rows])
        owners = np.concatenate([r["owner"] for r in rows])
        run, shift = (np.concatenate([r[k] for r in rows]) for k in ("run", "shift"))
        chunk = np.repeat([r["chunk"] for r in rows], [len(r["size"]) for r in rows])
        data = np.zeros(int(sizes.sum()) + 8, np.uint8)
        to = 0
        for r in rows:
            part = pa.decompress(r["content"], int(r["size"].sum()), "zstd", asbytes=True)
            data[to : to + len(part)] = np.frombuffer(part, np.uint8)
            to += len(part)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        del rows
        order = np.argsort(owners, kind="stable")
        count = (sizes - length + 1)[order]
        bounds = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(begin[order] - bounds[:-1], count) + np.arange(bounds[-1])
        hit = longest_previous_factor(data, at, np.repeat(owners[order], count), length) >= length
        edge = np.zeros(len(hit) + 1, np.int8)
        edge[:-1] = hit
        edge[bounds[:-1]] = 2 * edge[bounds[:-1]]  # a context begins: runs of hits never join over it
        begins = np.flatnonzero((edge[:-1] > 0) & ((edge[:-1] == 2) | np.concatenate(([True], edge[:-2] == 0))))
        which = np.searchsorted(bounds, begins, "right") - 1
        stops = np.flatnonzero((edge[:-1] > 0) & ((edge[1:] == 0) | (edge[1:] == 2))) + 1
        moved = shift[order][which] - bounds[which]
        found = np.stack((run[order][which], begins + moved, stops + moved)).astype("<i8")
        to = chunk[order][which]
        by = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], to[by][1:] != to[by][:-1], [True]))) if len(by) else np.zeros(1, np.int64)
        give_back()
        return pa.table({"chunk": pa.array(to[by][cut[:-1]] if len(by) else [], pa.int64()), "payload": pa.array([found[:, by[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return factors


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_bytes(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, found: pa.Table, length: int) -> np.ndarray:
    """Which bytes of a chunk go: what the buckets found, and contents that a smaller id of the chunk holds."""
    n = int(offsets[-1])
    start, stop, _ = runs(data, offsets, length)
    step = np.zeros(n + 1, np.int32)
    if len(start):
        first, number, owner = holders(data, offsets, ids, start, stop, length)
        later = np.flatnonzero(owner > owner[first][number])
        np.add.at(step, start[later], 1)
        np.add.at(step, stop[later] + length - 1, -1)
        parts = [np.frombuffer(x, "<i8").reshape(3, -1) for x in found["payload"].to_pylist()] if len(found) else []
        if parts:
            run, a, b = np.concatenate(parts, axis=1)
            by = np.argsort(number[run], kind="stable")
            at = np.searchsorted(number[run][by], np.arange(len(first) + 1))
            hit = np.flatnonzero(np.diff(at)[number] > 0)  # every run whose content was found takes its ranges
            pick, bounds = ragged(by, at, number[hit])
            base = np.repeat(start[hit], np.diff(bounds))
            np.add.at(step, base + a[pick], 1)
            np.add.at(step, base + b[pick] + length - 1, -1)
    gone = np.cumsum(step[:n], dtype=np.int32) > 0
    give_back()
    return gone


def _remove(length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        cols: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}

        def add(*values: object) -> None:
            for c, v in zip(cols.values(), values, strict=True):
                c.append(v)

        for text in docs.filter(pc.is_null(docs["doc_id"]))["text"].to_pylist():
            add(None, len(text), 0, 0, hashlib.sha256(text).hexdigest())
        docs = docs.filter(pc.is_valid(docs["doc_id"]))
        if len(docs):
            _, ids, data, offsets = chunk_text(docs)
            gone = removed_bytes(data, offsets, ids, found, length)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(gone)]
            begins[inner] = gone[inner]
            for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                lost = gone[a:b]
                kept = data[a:b][~lost] if lost.any() else data[a:b]
                add(i, b - a, int(lost.sum()), int(begins[a:b].sum()), hashlib.sha256(kept.tobytes()).hexdigest())
        return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in cols.items()})

    return remove


def _clean(length: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def clean(docs: pa.Table, found: pa.Table) -> pa.Table:
        nameless, docs = docs.filter(pc.is_null(docs["doc_id"])), docs.filter(pc.is_valid(docs["doc_id"]))
        texts = [t.decode() for t in nameless["text"].to_pylist()]
        if len(docs):
            docs, ids, data, offsets = chunk_text(docs)
            gone = removed_bytes(data, offsets, ids, found, length)
            texts += [data[a:b][~gone[a:b]].tobytes().decode(errors="ignore") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        rows = pa.concat_tables([nameless, docs])
        rest = rows["rest"].combine_chunks() if len(rows) else None
        held = lambda n: pc.struct_field(rest, n) if rest is not None else pa.array([])
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names and pa.types.is_integer(held("n_chars").type):
            new["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(held("n_chars").type, safe=False)
        return pa.table({n: new[n] if n in new else held(n) for n in names})

    return clean


def _found(docs: DataFrame, length: int, chunk_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their chunk, what the buckets found for each chunk)."""
    total = small_batches(docs).select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(LEAST_CHUNKS, -(-total // chunk_bytes))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # by id and text, so that neither documents without an id nor an id with many texts fill a chunk
    chunk, n_buckets = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)), BUCKETS * n_chunks
    dealt = docs.select(chunk.alias("chunk"), "doc_id", text.alias("text"))
    sent = dealt.groupBy("chunk").applyInArrow(_send(n_buckets, length), "bucket long, chunk long, hashes binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared(hot), "chunk long, payload binary, splits binary")
    contexts = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_contexts(n_buckets, length), CONTEXTS)
    found = contexts.groupBy("bucket").applyInArrow(_factors(length), "chunk long, payload binary")
    whole = docs.select(chunk.alias("chunk"), "doc_id", text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    return whole, found


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    whole, found = _found(docs, length, chunk_bytes, hot)
    return whole.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remove(length), OUT)


def cut_repeats(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """All documents without their repeated passages; other columns stay, n_chars (if there is one, and it is a whole number) follows the text.

    The bytes of a character that a removal splits go with it, so what is left is text.
    """
    whole, found = _found(docs, length, chunk_bytes, hot)
    return whole.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_clean(length, docs.columns), docs.schema)
