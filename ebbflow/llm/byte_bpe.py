"""Byte-level BPE encoding and decoding: Spark higher-order functions fold ranked merges over distinct words.

1. Tasks cut the texts of a block of documents into words (matches of the tokenizer's pattern) and number the block's
   distinct words.  A block keeps its texts as word numbers, and sends the words that are no pieces of the vocabulary
   themselves to buckets by their hash, each once for a block.
2. A bucket unites the words of all blocks, so each distinct word of the table is folded once.  A word is an array of
   the ids of its bytes; the fold merges, again and again, the leftmost adjacent pair of lowest rank.  The rank map is
   a literal of the running plan, bound by scalar subqueries so that no plan or event spells half a million numbers out.
3. The folds' ids go back to the blocks that hold the words, which put them in the place of word numbers.  What comes
   out are the documents' ids; decoding takes ids, however they were made, and concatenates the vocabulary's pieces.

What is shuffled is the blocks (word numbers, about half of the texts' bytes), and twice their distinct words.  A block,
and so a task, holds BLOCK_BYTES of text or one longer document; a bucket's share of words stays the same as tables grow, as
their number grows with the bytes of text, and the most frequent words, being pieces, are never sent.

Defined results: ids are little-endian 32-bit numbers, one after the other; a null text is empty and has no ids; null
ids decode to null, and ids that are not of the vocabulary raise; a null doc_id keeps its row; repeated rows are kept,
one result each; an empty table gives an empty result; extra columns are ignored; a very long text is a block of its
own.  A word of more than LONG_WORD bytes is merged by a priority queue with the same result, as a fold is quadratic in
a word's length.  A block's key is a hash of its content: if a lost task made it again from rows in another order, the query
fails rather than mixing up words, so cut the lineage of an input whose order may change.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import distinct_spans, give_back, mix, ragged, small_batches, span_hashes, text_blocks
from ebbflow.llm.packing import segments

#: Bytes of text in a block, for each bucket of words, and the least number of buckets.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 16 << 20, 64
#: Words that one row brings to the fold.
FOLDED = 4096
LONG_WORD = 4096
#: Rows of the rank map are laid over each other in an array of entries; an entry is left id << 20 | id of both joined.
NO_RANK, _EMPTY, _EDGE = 1 << 16, 1 << 40, 65_535


def read_ranks(path: str) -> dict[bytes, int]:
    """Binary piece -> rank (its id) of a .tiktoken file; ids must be below 65,535."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, starts): the entry of a pair of ids is entries[starts[left] + right], if it is the left id's own.

    Any two pieces that make a third are a pair.  Rows of right ids are laid over each other, long ones first, each at
    the first place that is free behind the last row of its length.
    """
    pairs = []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs.append((left, right, rank))
    lefts, rights, ids = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
    begin = np.searchsorted(lefts, np.arange(NO_RANK + 1))
    size = np.diff(begin)
    entries, starts = np.full(2 * NO_RANK, _EMPTY, np.int64), np.zeros(NO_RANK, np.int32)
    places: dict[int, int] = {}
    for left in np.argsort(-size, kind="stable")[: np.count_nonzero(size)].tolist():
        row = rights[begin[left] : begin[left + 1]]
        span = 8192 if len(row) > 20 else 512
        at, found = places.get(len(row), 0), False
        while not found:
            if at + 2 * NO_RANK > len(entries):
                entries = np.append(entries, np.full(4 * NO_RANK, _EMPTY, np.int64))
            fits = np.logical_and.reduce([entries[at + r : at + r + span] == _EMPTY for r in row.tolist()])
            found = bool(fits.any())
            at += int(fits.argmax()) if found else span
        places[len(row)] = starts[left] = at
        entries[at + row] = left << 20 | ids[begin[left] : begin[left + 1]]
    return entries[: max(places.values(), default=0) + NO_RANK], starts


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


@lru_cache(maxsize=2)
def _rank_map(path: str) -> tuple[list[int], list[int]]:
    entries, starts = pair_table(read_ranks(path))
    return entries.tolist(), starts.tolist()


def with_rank_map(df: DataFrame, path: str) -> DataFrame:
    """df with the rank map's arrays in the columns `entries` and `starts`: for rows of many words, as each row gets a copy."""
    entries, starts = _rank_map(path)
    row = df.sparkSession.createDataFrame(pa.table({"entries": pa.array([entries], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int32()))}))
    return df.select("*", row.select("entries").scalar().alias("entries"), row.select("starts").scalar().alias("starts"))


def fold_merges(word: Column) -> Column:
    """ids (array of long) of a word (array of long: an edge that pairs with nothing, and the ids of the word's bytes).

    The state has a number for each id: the rank of the merge with the next id (which is the id of both joined) or
    NO_RANK, the place of its first byte, and the id itself.  So the least number is the next merge.
    """
    entries, starts = F.col("entries"), F.col("starts")
    low, place, rest = F.lit((1 << 44) - 1), F.lit((1 << 44) - (1 << 16)), F.lit(1 << 30)

    def rank(left: Column, right: Column) -> Column:  # where there is no right id, `least` passes over the null
        entry = F.get(entries, (F.get(starts, left.cast("int")) + right).cast("int"))
        return F.shiftleft(F.least(entry.bitwiseXOR(F.shiftleft(left, 20)), F.lit(NO_RANK).cast("bigint")), 44)

    def merged(state: Column, p: Column, least: Column) -> Column:
        before, joined, after = F.get(state, p - 2), F.shiftright(least, 44), F.get(state, p + 1)
        pair = F.array(
            rank(before.bitwiseAND(65535), joined).bitwiseOR(before.bitwiseAND(low)),
            rank(joined, after.bitwiseAND(65535)).bitwiseOR(least.bitwiseAND(place)).bitwiseOR(joined),
        )
        return F.concat(F.slice(state, F.lit(1), p - 2), pair, F.slice(state, p + 2, rest))

    def step(state: Column, _: Column) -> Column:
        move = lambda least: F.when(least < NO_RANK << 44, _let(F.array_position(state, least).cast("int"), lambda p: merged(state, p, least))).otherwise(state)
        return _let(F.array_min(state), move)

    start = F.transform(word, lambda x, i: rank(x, F.get(word, i + 1)).bitwiseOR(F.shiftleft(i.cast("bigint"), 16)).bitwiseOR(x))
    steps = F.sequence(F.lit(1), F.greatest(F.size(word) - 2, F.lit(1)))
    return F.aggregate(steps, start, step, lambda s: F.transform(F.slice(s, F.lit(2), rest), lambda x: x.bitwiseAND(65535)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of a long word: the same merges by a priority queue over a linked list."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    queue = [(ranks[word[i : i + 2]], i, 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapify(queue)
    while queue:
        _, i, size = heappop(queue)
        j = after[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue  # one of both was merged otherwise meanwhile
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and parts[a] + parts[b] in ranks:
                heappush(queue, (ranks[parts[a] + parts[b]], a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


# Classes of bytes in texts that are cut without the pattern; two-byte letters are marked by their place.
_LETTER, _DIGIT, _SIGN, _GAP, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[0x20], _CLASS[ord("'")] = _GAP, _OTHER


def word_starts(data: np.ndarray, offsets: np.ndarray, split: Callable[[str], list[str]]) -> np.ndarray:
    """Starts of all words of a block of documents; words tile the texts.

    `segments` are cut where the pattern begins a word in any case.  Segments of an optional space and visible ASCII
    (without the apostrophe) or Latin letters of two bytes are cut where runs of letters, digits and signs meet; all
    others, each distinct one once, by the pattern.
    """
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data[:n]]
    lead = np.flatnonzero(data[: n - 1] == 0xC3)
    trail = data[lead + 1]
    lead = lead[(trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    starts = segments(data, offsets)
    ends = np.append(starts[1:], n)
    begins = np.ones(n, bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _GAP)
    begins[starts] = True
    odd = kind >= _GAP
    odd[starts[data[starts] == 0x20]] = False
    hard = np.flatnonzero(np.add.reduceat(odd, starts, dtype=np.int32) > 0) if odd.any() else np.zeros(0, np.int64)
    if len(hard):
        chosen, number = distinct_spans(data, starts[hard], ends[hard])
        raw = data.tobytes()
        cuts = [np.cumsum([0, *(len(w.encode()) for w in split(raw[a:b].decode())[:-1])]) for a, b in zip(starts[hard[chosen]].tolist(), ends[hard[chosen]].tolist(), strict=True)]
        at, bounds = ragged(np.concatenate(cuts), np.concatenate(([0], np.cumsum([len(c) for c in cuts]))), number)
        size = (ends - starts)[hard]
        inside = np.concatenate(([0], np.cumsum(size)))
        begins[np.repeat(starts[hard] - inside[:-1], size) + np.arange(inside[-1])] = False
        begins[np.repeat(starts[hard], np.diff(bounds)) + at] = True
    return np.flatnonzero(begins)


def _press(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpress(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _press_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers, planes of their bytes apart."""
    return pa.compress(b"".join((numbers >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)), "zstd", asbytes=True)


def _unpress_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


#: A block: a hash of its content, its documents' ids, how many words each has, the words' numbers, the ids of numbers that are pieces (else -1);
#: for each bucket its words, which have the numbers from `firsts` on.
BLOCKS = "block long, doc_ids array<long>, counts binary, n_words long, numbers binary, n_distinct long, known binary, buckets array<long>, firsts array<long>, n_sent array<long>, sizes array<binary>, words array<binary>"


def _block_row(data: np.ndarray, offsets: np.ndarray, split: Callable[[str], list[str]], ranks: dict[bytes, int], n_buckets: int) -> dict:
    starts = word_starts(data, offsets, split)
    ends = np.append(starts[1:], offsets[-1])[: len(starts)]
    chosen, number = distinct_spans(data, starts, ends)
    # pieces first, the most frequent before all others; then the rest by bucket
    raw = data.tobytes()
    known = np.array([ranks.get(raw[a:b], -1) for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)], np.int32)
    bucket = (mix(span_hashes(data, starts[chosen], ends[chosen])) >> np.uint64(33)).astype(np.int64) % n_buckets
    often = np.bincount(number, minlength=len(chosen))
    order = np.lexsort((np.where(known < 0, bucket, -often), known < 0))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n_known = int((known >= 0).sum())
    sent = chosen[order[n_known:]]
    b = bucket[order[n_known:]]
    edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, np.int64)
    size = (ends - starts)[sent]
    content, to = _spans(data, starts[sent], size)
    numbers = place[number]
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return {
        "counts": _press_numbers(np.diff(np.searchsorted(starts, offsets))), "n_words": len(numbers), "numbers": _press_numbers(numbers), "n_distinct": len(order), "known": known[order[:n_known]].astype("<i4").tobytes(),
        "buckets": [int(b[i]) for i, _ in parts], "firsts": [n_known + i for i, _ in parts], "n_sent": [j - i for i, j in parts], "sizes": [_press_numbers(size[i:j]) for i, j in parts], "words": [pa.compress(content[to[i] : to[j]].tobytes(), "zstd", asbytes=True) for i, j in parts],
    }


def _spans(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and their bounds."""
    to = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(starts - to[:-1], size) + np.arange(to[-1])], to


def _number(pattern: str, path: str, n_buckets: int, block_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, ranks, made = regex.compile(pattern).findall, read_ranks(path), 0
        schema = pa.schema([(n, _ARROW[k]) for n, k in (f.split(" ") for f in BLOCKS.split(", "))])
        for ids, data, offsets in _gathered(batches, block_bytes):
            row = _block_row(data, offsets, split, ranks, n_buckets)
            own = hashlib.blake2b(b"%d %d" % (TaskContext.get().partitionId(), made), digest_size=8)
            for part in (row["numbers"], row["counts"], *row["words"]):
                own.update(part)
            row |= {"block": int.from_bytes(own.digest(), "little", signed=True), "doc_ids": ids}
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
        give_back()

    return number


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _gathered(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, data, offsets) of blocks of up to block_bytes, or one longer document, over the borders of batches."""
    ids, parts, sizes, held = [], [], [], 0

    def whole() -> tuple[list, np.ndarray, np.ndarray]:
        return ids, np.concatenate([*parts, np.zeros(8, np.uint8)]), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column("text"), block_bytes // 4):
            if ids and held + int(offsets[-1]) > block_bytes:
                yield whole()
                ids, parts, sizes, held = [], [], [], 0
            ids = ids + batch.column("doc_id").slice(first, last - first).to_pylist()
            parts.append(data[:-8])
            sizes.append(np.diff(offsets))
            held += int(offsets[-1])
    if ids:
        yield whole()


def _deal(key: tuple, table: pa.Table) -> pa.Table:
    """A row for each bucket that a block sends words to."""
    cols: dict[str, list] = {"bucket": [], "first": [], "n": [], "sizes": [], "words": []}
    for row in table.select(["buckets", "firsts", "n_sent", "sizes", "words"]).to_pylist():
        for c, name in zip(cols.values(), row, strict=True):
            c += row[name]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({"block": pa.array([key[0].as_py()] * len(cols["bucket"]), pa.int64())} | {n: pa.array(c, k) for (n, c), k in zip(cols.items(), kinds, strict=True)})


#: Some words of a bucket; its last row has who asked: for each block its first place and how many, then all words asked for.
FOLDS = "words array<array<long>>, ready array<binary>, last boolean, blocks array<long>, firsts array<long>, counts array<long>, asked binary"


def _unite(path: str) -> Callable[[tuple, pa.Table], pa.Table]:
    ranks: dict[bytes, int] = {}

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        """The distinct words of a bucket in rows of FOLDED words."""
        if not ranks:
            ranks.update(read_ranks(path))
        byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        counts = table["n"].to_pylist()
        size = np.concatenate([_unpress_numbers(s, n) for s, n in zip(table["sizes"].to_pylist(), counts, strict=True)]).astype(np.int64)
        ends = np.cumsum(size)
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        data = np.frombuffer(b"".join([*(pa.decompress(w, int(n), "zstd", asbytes=True) for w, n in zip(table["words"].to_pylist(), np.diff(edges), strict=True)), bytes(8)]), np.uint8)
        chosen, number = distinct_spans(data, ends - size, ends)
        rows: dict[str, list] = {f.split(" ")[0]: [] for f in FOLDS.split(", ")}
        for a in range(0, len(chosen), FOLDED):
            some = chosen[a : a + FOLDED]
            short = size[some] <= LONG_WORD
            bounds = np.concatenate(([0], np.cumsum(np.where(short, size[some] + 1, 1))))
            flat = np.full(bounds[-1], _EDGE, np.int64)
            content, to = _spans(data, (ends - size)[some[short]], size[some[short]])
            flat[np.repeat(bounds[:-1][short] + 1 - to[:-1], np.diff(to)) + np.arange(to[-1])] = byte[content]
            last = a + FOLDED >= len(chosen)
            rows["words"].append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)))
            rows["ready"].append([np.array(merge_long(data[ends[w] - size[w] : ends[w]].tobytes(), ranks), "<u2").tobytes() for w in some[~short].tolist()])
            for name, value in (("last", last), ("blocks", table["block"].to_pylist()), ("firsts", table["first"].to_pylist()), ("counts", counts), ("asked", number.astype("<i4").tobytes())):
                rows[name].append(value if last else None)
        rows["last"] = [bool(x) for x in rows["last"]]
        give_back()
        words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(w) for w in rows["words"]]))), pa.int32()), pa.concat_arrays(rows["words"]))
        kinds = {"ready": pa.list_(pa.binary()), "last": pa.bool_(), "blocks": pa.list_(pa.int64()), "firsts": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "asked": pa.binary()}
        return pa.table({n: words if n == "words" else pa.array(v, kinds[n]) for n, v in rows.items()})

    return unite


#: The ids of the words of a block that have the numbers from `first` on.
ANSWERS = "block long, first long, n long, n_ids long, sizes binary, ids binary"


def _answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, the ids of the words that it asked a bucket for; a bucket's rows come one after the other."""
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for batch in batches:
        for r in range(len(batch)):
            folded = batch.column("ids")[r].values
            size, flat = np.diff(folded.offsets.to_numpy()), folded.flatten().to_numpy().astype("<u2")
            ready = [np.frombuffer(x, "<u2") for x in batch.column("ready")[r].as_py()]
            if ready:  # long words came without bytes, and have no ids from the fold
                at = np.flatnonzero(size == 0)
                cuts = np.split(flat, np.cumsum(size)[at])
                flat = np.concatenate([cuts[0], *(x for pair in zip(ready, cuts[1:], strict=True) for x in pair)])
                size[at] = [len(x) for x in ready]
            parts.append(flat)
            sizes.append(size)
            if not batch.column("last")[r].as_py():
                continue
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
            parts, sizes, at = [], [], 0
            asked = np.frombuffer(batch.column("asked")[r].as_py(), "<i4")
            cols: list[list] = [[] for _ in range(6)]
            for block, first, n in zip(*(batch.column(c)[r].as_py() for c in ("blocks", "firsts", "counts")), strict=True):
                own, to = ragged(ids, bounds, asked[at : at + n])
                at += n
                for c, v in zip(cols, (block, first, n, len(own), _press_numbers(np.diff(to)), _press(own, "<u2")), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.binary()) for i, c in enumerate(cols)], names=["block", "first", "n", "n_ids", "sizes", "ids"])
    give_back()


def _assemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """doc_id and ids of a block's documents."""
    if len(blocks) != 1:
        raise ValueError("a block was made again from rows in another order: cut the lineage of the documents first")
    doc_ids, out = [], []
    for row in blocks.to_pylist():
        n_distinct, known = row["n_distinct"], np.frombuffer(row["known"], "<i4")
        sizes = np.zeros(n_distinct, np.int64)
        sizes[: len(known)] = 1
        got = [(r["first"] + np.arange(r["n"]), _unpress_numbers(r["sizes"], r["n"]), _unpress(r["ids"], r["n_ids"], "<u2")) for r in answers.to_pylist()]
        asked = np.concatenate([p for p, _, _ in got]) if got else np.zeros(0, np.int64)
        if len(asked) != n_distinct - len(known) or (len(asked) and int(np.bincount(asked, minlength=n_distinct)[len(known) :].min()) != 1):
            raise ValueError("a block was made again from rows in another order: cut the lineage of the documents first")
        counts = np.concatenate([s for _, s, _ in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        ids = np.concatenate([known.astype("<u2"), *[i for _, _, i in got]])
        sizes[asked] = counts
        begin = np.zeros(n_distinct, np.int64)
        begin[: len(known)] = np.arange(len(known))
        begin[asked] = len(known) + np.cumsum(counts) - counts
        numbers = _unpress_numbers(row["numbers"], row["n_words"])
        ends = np.cumsum(_unpress_numbers(row["counts"], len(row["doc_ids"])), dtype=np.int64)
        at = 0
        for end in ends.tolist():
            words = numbers[at:end]
            out.append(_spans(ids, begin[words], sizes[words])[0].astype("<u4").tobytes() if end > at else b"")
            at = end
        doc_ids += row["doc_ids"]
    give_back()
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())})


def _decode(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: p for p, i in read_ranks(path).items()}
        size = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)], np.int64)
        data, begin = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size
        for batch in batches:
            out = []
            for value in batch.column("ids"):
                ids = None if value.as_py() is None else np.frombuffer(value.as_buffer(), "<u4")
                if ids is not None and len(ids) and not size[ids].all():  # an id beyond the array raises by itself
                    raise ValueError("ids that are not of the vocabulary")
                out.append(None if ids is None else _spans(data, begin[ids], size[ids])[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])
        give_back()

    return decode


def token_ids(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, ids of every document."""
    docs = small_batches(docs.select("doc_id", "text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    blocks = docs.mapInArrow(_number(pattern, ranks_path, n_buckets, block_bytes), BLOCKS)
    # both consumers group whole blocks by their key, so they share one exchange of them
    sent = blocks.groupBy("block").applyInArrow(_deal, "block long, bucket long, first long, n long, sizes binary, words binary")
    united = sent.groupBy("bucket").applyInArrow(_unite(ranks_path), FOLDS)
    folded = with_rank_map(united, ranks_path).select(F.transform("words", fold_merges).alias("ids"), "ready", "last", "blocks", "firsts", "counts", "asked")
    answers = folded.mapInArrow(_answer, ANSWERS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded (binary: the bytes that the ids stand for) of every row of doc_id and ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks_path), "doc_id long, ids binary, decoded binary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: digests of its ids and of what they decode to."""
    both = decode_documents(token_ids(docs, ranks_path, pattern), ranks_path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
