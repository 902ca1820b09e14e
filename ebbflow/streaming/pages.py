"""Keyed state in pages: what a state processor keeps of many keys, of a side's rows, or of a group's ordered values.

A call to the state store costs far more than a key, so keys live in pages of some dozens, each a JSON text.  A processor
reads and writes the pages of the keys that change, however many there are beside them.  Keys of plain sums live in pages of
some thousands, each a batch of Arrow columns, so that Python does nothing key by key.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Keys of a page, or entries of a tree's node, before it is split.
PAGE_KEYS = 128
#: Keys of a page of columns before its table has another page.
COLUMN_KEYS = 8192
#: Rows of a key that lie beside those of other keys; a key with more of them has pages of its own.
SHARED_ROWS = 32


def _dumps(body: Any) -> str:
    return json.dumps(body, ensure_ascii=False, separators=(",", ":"))


class Pages:
    """A hash table from texts to lists of plain values over a map state (page -> JSON): linear hashing.

    Page 0 also holds the number of pages, which is all there is to the layout: a page that has grown too long makes one
    page be split, and no other page is touched.  The layout is written with page 0, in every flush that changes
    it; where keys have a time to live, page 0 is written in every flush, so the layout outlives all pages.  A time to live
    counts for each key, from its own last change: `ttl` and `now` in milliseconds.  `total` is a number of the
    owner's, `mark` a note of it.
    """

    def __init__(self, state: Any, ttl: int | None = None, now: int = 0):
        self.state, self.ttl, self.now = state, ttl, now
        held = state.getValue((0,))
        head = json.loads(held[0]) if held else {"pages": 1, "total": 0, "keys": {}}
        self.pages, self.total, self.mark = head["pages"], head["total"], head.get("mark")
        self._was = (self.pages, self.total, self.mark)
        self._loaded: dict[int, dict[str, list]] = {0: self._live(head["keys"])}
        self._dirty: set[int] = set()
        self.reads = 1

    def _live(self, keys: dict[str, list]) -> dict[str, list]:
        return keys if self.ttl is None else {k: v for k, v in keys.items() if self.now - v[-1] < self.ttl}

    def _page(self, i: int) -> dict[str, list]:
        page = self._loaded.get(i)
        if page is None:
            held = self.state.getValue((i,))
            page = self._loaded[i] = self._live(json.loads(held[0])) if held else {}
            self.reads += 1
        return page

    def _at(self, key: str) -> int:
        low = (1 << (self.pages.bit_length() - 1)) - 1
        h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
        at = h & (2 * low + 1)
        return at if at < self.pages else at & low

    def get(self, key: str) -> list | None:
        """The key's values, without the time of their last change."""
        values = self._page(self._at(key)).get(key)
        return values if values is None or self.ttl is None else values[:-1]

    def put(self, key: str, values: list | None) -> None:
        """New values of a key; None removes it."""
        at = self._at(key)
        page = self._page(at)
        if values is not None:
            page[key] = values if self.ttl is None else [*values, self.now]
        elif page.pop(key, None) is None:
            return
        self._dirty.add(at)

    def items(self) -> Iterator[tuple[str, list]]:
        """All keys and their values, as they are now."""
        for i in range(self.pages):
            for k, v in list(self._page(i).items()):
                yield k, v if self.ttl is None else v[:-1]

    def fill(self, rows: dict[str, list]) -> None:
        """All rows of an empty table, as pages hold them."""
        self._loaded, self._dirty = {0: dict(rows)}, {0}

    def drop(self) -> None:
        """Remove every page."""
        for i in range(self.pages):
            self.state.removeKey((i,))
        self.pages, self.total, self.mark, self._loaded, self._dirty, self._was = 1, 0, None, {0: {}}, set(), (1, 0, None)

    @property
    def dirty(self) -> bool:
        return bool(self._dirty) or (self.pages, self.total, self.mark) != self._was

    def _split(self) -> None:
        """One page more, which takes its keys from one page."""
        source = self.pages - (1 << (self.pages.bit_length() - 1))
        keys, new = self._page(source), self.pages
        self.pages += 1
        self._loaded[source], self._loaded[new] = {}, {}
        for k, v in keys.items():
            self._loaded[self._at(k)][k] = v
        self._dirty |= {source, new}

    def flush(self) -> None:
        """Write what has changed: grown pages make as many splits as they hold pages too many."""
        for _ in range(sum((len(self._loaded[i]) - 1) // PAGE_KEYS for i in self._dirty)):
            self._split()
        now = (self.pages, self.total, self.mark)
        if self._was != now or self._dirty and self.ttl is not None:
            self._dirty.add(0)
        for i in self._dirty:
            page = self._loaded[i]
            if i == 0 and (page or now != (1, 0, None)):
                head = {"pages": self.pages, "total": self.total, "keys": page} | ({} if self.mark is None else {"mark": self.mark})
                self.state.updateValue((0,), (_dumps(head),))
            elif page:
                self.state.updateValue((i,), (_dumps(page),))
            else:
                self.state.removeKey((i,))
        self._dirty, self._was = set(), now


class ColumnPages:
    """A hash table of Arrow rows over a map state (page -> Arrow stream): linear hashing, by a column of 32-bit hashes.

    Rows of one hash lie in one page.  Page 0 says how many pages there are, and is written whenever that changes; a page that
    has grown too long makes one page be split for each page that it holds too many.
    """

    #: Arrow's own compression of each column.
    WRITTEN = pa.ipc.IpcWriteOptions(compression="lz4")

    def __init__(self, state: Any, schema: pa.Schema, hashes: str):
        self.state, self.schema, self.hashes, self.pages = state, pa.schema([f.with_nullable(True) for f in schema]), hashes, 1
        held = state.getValue((0,))
        self._first = pa.ipc.open_stream(held[0]).read_all() if held else self.schema.empty_table()
        if held:
            self.pages = int(self._first.schema.metadata[b"pages"])

    def _at(self, hashes: pa.ChunkedArray) -> np.ndarray:
        low = (1 << (self.pages.bit_length() - 1)) - 1
        at = hashes.to_numpy().astype(np.int64) & (2 * low + 1)
        return np.where(at < self.pages, at, at & low)

    def pages_of(self, hashes: pa.ChunkedArray) -> set[int]:
        return set(np.unique(self._at(hashes)).tolist())

    def load(self, pages: set[int]) -> pa.Table:
        """All rows of some pages."""
        held = [self._first.replace_schema_metadata(None)] if 0 in pages else []
        for i in sorted(pages - {0}):
            if page := self.state.getValue((i,)):
                held.append(pa.ipc.open_stream(page[0]).read_all().replace_schema_metadata(None))
        return pa.concat_tables(held) if held else self.schema.empty_table()

    def store(self, pages: set[int], rows: pa.Table) -> None:
        """New rows of some pages: all that they hold from now on."""
        rows = rows.select(self.schema.names).cast(self.schema)
        more = int(((np.bincount(self._at(rows[self.hashes])) - 1) // COLUMN_KEYS).clip(0).sum()) if rows.num_rows else 0
        if more:
            new = range(self.pages, self.pages + more)
            split = {self._origin(i) for i in new} | {0}  # page 0 has the layout
            rows = pa.concat_tables([rows, self.load(split - pages)])
            self.pages, pages = self.pages + more, pages | split | set(new)
        at = self._at(rows[self.hashes])
        order = np.argsort(at, kind="stable")
        rows, at, ids = rows.combine_chunks().take(order), at[order], sorted(pages)
        for i, a, b in zip(ids, np.searchsorted(at, ids, "left").tolist(), np.searchsorted(at, ids, "right").tolist(), strict=True):
            if a < b or i == 0 and self.pages > 1:
                self._write(i, rows.slice(a, b - a))
            else:
                self.state.removeKey((i,))

    def _origin(self, page: int) -> int:
        """The page, of those that there are, whose rows a new page takes."""
        while page >= self.pages:
            page -= 1 << (page.bit_length() - 1)
        return page

    def _write(self, i: int, rows: pa.Table) -> None:
        schema = self.schema.with_metadata({"pages": str(self.pages)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=self.WRITTEN) as stream:
            stream.write_table(rows.replace_schema_metadata(schema.metadata))
        self.state.updateValue((i,), (sink.getvalue().to_pybytes(),))


class Owned:
    """What belongs to one owner in a map state whose keys begin with an owner."""

    def __init__(self, state: Any, owner: str):
        self.state, self.owner = state, owner

    def getValue(self, key: tuple) -> Any:
        return self.state.getValue((self.owner, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.state.updateValue((self.owner, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.state.removeKey((self.owner, *key))


class Small:
    """A key's table of few rows, an entry of shared pages, with what `Pages` offers: [total, mark, rows]."""

    def __init__(self, held: list | None, ttl: int | None, now: int):
        self.ttl, self.now = ttl, now
        self.total, self.mark, rows = held or (0, None, {})
        self.rows: dict[str, list] = rows if ttl is None else {k: v for k, v in rows.items() if now - v[-1] < ttl}
        self._was, self.changed = (self.total, self.mark), False

    def get(self, key: str) -> list | None:
        values = self.rows.get(key)
        return values if values is None or self.ttl is None else values[:-1]

    def put(self, key: str, values: list | None) -> None:
        if values is not None:
            self.rows[key] = values if self.ttl is None else [*values, self.now]
        elif self.rows.pop(key, None) is None:
            return
        self.changed = True

    def items(self) -> Iterator[tuple[str, list]]:
        for k, v in list(self.rows.items()):
            yield k, v if self.ttl is None else v[:-1]

    @property
    def dirty(self) -> bool:
        return self.changed or (self.total, self.mark) != self._was


class Tables:
    """The tables of a bucket's many keys over one map state ((owner, page) -> JSON): a call brings them all.

    Small tables lie together in the pages of no owner.  One that has grown beyond SHARED_ROWS is a table of pages that its
    key owns, and an entry without rows says so.
    """

    def __init__(self, state: Any, ttl: int | None = None, now: int = 0):
        self.state, self.ttl, self.now = state, ttl, now
        self.index = Pages(Owned(state, ""), ttl, now)

    def keys(self) -> list[str]:
        return [k for k, _ in self.index.items()]

    def table(self, key: str) -> Pages | Small:
        held = self.index.get(key)
        if held and held[2] is None:
            return Pages(Owned(self.state, key), self.ttl, self.now)
        return Small(held, self.ttl, self.now)

    def close(self, key: str, table: Pages | Small) -> None:
        """Bring a table's changes to the state; those of small ones are written by `flush`."""
        if isinstance(table, Small):
            if not table.dirty:
                return
            if len(table.rows) <= SHARED_ROWS:
                entry = [table.total, table.mark, table.rows]
                self.index.put(key, entry if table.rows or table.total or table.mark is not None else None)
                return
            grown = Pages(Owned(self.state, key), self.ttl, self.now)
            grown.fill(table.rows)
            grown.total, grown.mark = table.total, table.mark
            table = grown
            self.index.put(key, [0, None, None])
        elif table.dirty:
            if self.ttl is not None:
                self.index.put(key, [0, None, None])  # the entry lives as long as the rows
            elif table.total <= 0 and table.mark is None and next(table.items(), None) is None:
                table.drop()
                self.index.put(key, None)
                return
        table.flush()

    def flush(self) -> None:
        self.index.flush()


class Sorted:
    """A sorted multiset over a map state ((tree, node) -> JSON): a B+ tree whose nodes are pages.

    Entries are [order text, value's text, count]; a change or an extreme reads the nodes on its way from the root,
    so the work does not depend on how many values there are beside it.
    """

    def __init__(self, state: Any, tree: int):
        self.state, self.tree = state, tree
        self._nodes: dict[int, dict] = {}
        self.reads = 0
        held = state.getValue((tree, 0))
        self._nodes[0] = json.loads(held[0]) if held else {"next": 1, "leaf": True, "items": []}

    def _node(self, i: int) -> dict:
        node = self._nodes.get(i)
        if node is None:
            node = self._nodes[i] = json.loads(self.state.getValue((self.tree, i))[0])
            self.reads += 1
        return node

    def _store(self, i: int, node: dict | None) -> None:
        if node is None:
            self._nodes.pop(i, None)
            self.state.removeKey((self.tree, i))
        else:
            self._nodes[i] = node
            self.state.updateValue((self.tree, i), (_dumps(node),))

    def change(self, changes: dict[str, tuple[str, int]]) -> None:
        """Add to the counts: order text -> (value's text, number); entries that come to zero go."""
        if not changes:
            return
        root = self._nodes[0]
        items = self._changed(root, [(k, *changes[k]) for k in sorted(changes)])
        while len(items) > PAGE_KEYS:  # the root's entries move into children
            items = [[part[0][0], self._fresh({"leaf": root["leaf"], "items": part})] for part in self._parts(items)]
            root["leaf"] = False
        if not items:
            root["leaf"] = True
        elif not root["leaf"] and len(items) == 1:  # a chain of one child shortens
            only = items[0][1]
            child = self._node(only)
            root["leaf"], items = child["leaf"], child["items"]
            self._store(only, None)
        root["items"] = items
        self._store(0, root if items else None)
        if not items:
            self._nodes[0] = root

    def _fresh(self, node: dict) -> int:
        i = self._nodes[0]["next"]
        self._nodes[0]["next"] += 1
        self._store(i, node)
        return i

    @staticmethod
    def _parts(items: list) -> list[list]:
        half = max(2, PAGE_KEYS // 2)
        return [items[a : a + half] for a in range(0, len(items), half)]

    def _changed(self, node: dict, changes: list[tuple[str, str, int]]) -> list:
        """A node's entries after the changes."""
        if node["leaf"]:
            held = {k: [k, text, n] for k, text, n in node["items"]}
            for k, text, n in changes:
                entry = held.setdefault(k, [k, text, 0])
                entry[2] += n
            return [held[k] for k in sorted(held) if held[k][2]]
        lows, out, at = [low for low, _ in node["items"]], [], 0
        for i, (low, child_id) in enumerate(node["items"]):
            end = bisect_left(changes, (lows[i + 1],)) if i + 1 < len(lows) else len(changes)
            if end == at:
                out.append([low, child_id])
                continue
            child = self._node(child_id)
            items = self._changed(child, changes[at:end])
            at = end
            parts = self._parts(items) if len(items) > PAGE_KEYS else [items] if items else []
            self._store(child_id, {"leaf": child["leaf"], "items": parts[0]} if parts else None)
            out += [[part[0][0], child_id if j == 0 else self._fresh({"leaf": child["leaf"], "items": part})] for j, part in enumerate(parts)]
        return out

    def extreme(self, last: bool) -> str | None:
        """The text of the smallest or the largest value."""
        node = self._nodes[0]
        if not node["items"]:
            return None
        while not node["leaf"]:
            node = self._node(node["items"][-1 if last else 0][1])
        return node["items"][-1 if last else 0][1]

    def between(self, low: str, high: str) -> Iterator[tuple[str, int]]:
        """(value's text, count) of the entries from low to high, both included, in order."""

        def walk(node: dict) -> Iterator[tuple[str, int]]:
            if node["leaf"]:
                keys = [k for k, _, _ in node["items"]]
                for _, text, n in node["items"][bisect_left(keys, low) : bisect_right(keys, high)]:
                    yield text, n
                return
            lows = [k for k, _ in node["items"]]
            for _, child in node["items"][max(0, bisect_right(lows, low) - 1) : bisect_right(lows, high)]:
                yield from walk(self._node(child))

        yield from walk(self._nodes[0])


def page_of(key: str, pages: int) -> int:
    """The page that holds a key in a table of so many pages."""
    low = (1 << (pages.bit_length() - 1)) - 1
    at = zlib.crc32(key.encode("utf-8", "surrogatepass")) & (2 * low + 1)
    return at if at < pages else at & low


def body(pages: Iterable[tuple[int, str]]) -> dict[str, list]:
    """The keys of a table's pages, as read from a checkpoint: (page, JSON)."""
    out: dict[str, list] = {}
    for i, text in pages:
        held = json.loads(text)
        out |= held["keys"] if i == 0 else held
    return out
