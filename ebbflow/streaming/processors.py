"""State processors for transformWithStateInPandas: each keeps state and emits the difference that a micro-batch makes.

Rows arrive with a weight in the sign column.  A processor yields new rows with +1 and the rows they replace with -1,
additions first, and nothing if nothing changed.  State of groups that net to nothing is deleted.  Keys and rows are exact
texts (see `codec`), so no value passes through pandas; state is in pages (see `pages`), so a change costs what it touches.
"""

from __future__ import annotations

import functools
import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ebbflow.operators.aggregates import Aggregate
from ebbflow.operators.ordering import order_text
from ebbflow.signed import SIGN
from ebbflow.streaming.codec import readers, text_of_values, values_of, written
from ebbflow.streaming.pages import SHARED_ROWS, ColumnPages, Owned, Pages, Small, Sorted, Tables

KEY, ROW, BUCKET, PACKED, HASH = "key__", "row__", "bucket__", "packed__", "hash__"
#: Most rows that a processor yields at once.
FRAME_ROWS = 50_000
#: The largest weight of a row that a processor yields: signs are ints.
LARGEST = (1 << 31) - 1


def signed_frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(column, dtype=object) for n, column in zip(names, zip(*rows, strict=True), strict=True)})


def framed(rows: Iterable[tuple], names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames of FRAME_ROWS rows, or a few more."""
    some: list[tuple] = []
    for r in rows:
        some.append(r)
        if len(some) >= FRAME_ROWS:
            yield signed_frame(some, names)
            some = []
    if some:
        yield signed_frame(some, names)


def in_parts(row: tuple) -> Iterator[tuple]:
    """A row, its weight last, as rows whose weights an int holds."""
    *values, n = row
    while n:
        part = max(-LARGEST, min(n, LARGEST))
        yield *values, part
        n -= part


def delta(key: str, old: Counter, new: Counter) -> list[tuple]:
    """The signed rows that lead from old to new results of a key, additions first."""
    return [(key, *r, n - old[r]) for r, n in new.items() if n > old[r]] + [(key, *r, new[r] - n) for r, n in old.items() if n > new[r]]


class Delta(StatefulProcessor):
    """inputs: the names of the columns that come in; ttls: milliseconds for each input after which untouched state goes, or None.

    packed: the columns of the rows that come in packed, many to a cell; summed: those that equal rows have the sums of.
    """

    inputs: Sequence[str] = ()
    packed: pa.Schema | None = None
    summed: Sequence[str] = (SIGN,)
    ttls: Sequence[int | None] = (None, None)

    def frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames with the columns' own names (names that begin with _ become positions on their way)."""
        for frame in rows:
            if self.packed is None:
                frame.columns = list(self.inputs)
                yield frame
            else:
                yield self.unpacked(frame).to_pandas()

    def unpacked(self, frame: pd.DataFrame) -> pa.Table:
        """The rows that came packed."""
        frame.columns = list(self.inputs)
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(cell), self.packed) for cell in frame[PACKED]])

    def changes(self, rows: Iterator[pd.DataFrame]) -> dict[str, dict[str, int]]:
        """Of every key of a bucket, the change of every row's text."""
        change: dict[str, dict[str, int]] = defaultdict(dict)
        for frame in self.frames(rows):
            for k, r, sign in zip(frame[KEY].tolist(), frame[ROW].tolist(), frame[SIGN].tolist(), strict=True):
                own = change[k]
                own[r] = own.get(r, 0) + sign
        return change

    def paged(self, handle: StatefulProcessorHandle, name: str, i: int = 0) -> Any:
        """A map state for the pages of the i-th input."""
        return handle.getMapState(name, "page int", "body string", self.ttls[i])

    def owned(self, handle: StatefulProcessorHandle, name: str, i: int = 0) -> Any:
        """A map state for the tables of many keys, of the i-th input."""
        return handle.getMapState(name, "owner string, page int", "body string", self.ttls[i])

    def table(self, state: Any, timers: Any, i: int = 0) -> Pages:
        return Pages(state, self.ttls[i], timers.getCurrentProcessingTimeInMs())

    def tables(self, state: Any, timers: Any, i: int = 0) -> Tables:
        return Tables(state, self.ttls[i], timers.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def apply(table: Pages | Small, change: dict[str, int]) -> dict[str, int]:
    """Bring the stored weights to what they are with a change; how often each row counts more or less than before.

    A row counts as often as its weight is above zero; the table's total is the sum of that, where nothing is forgotten.
    """
    moved = {}
    for r, n in change.items():
        if not n:
            continue
        held = table.get(r)
        was = held[0] if held else 0
        table.put(r, [was + n] if was + n else None)
        if more := max(was + n, 0) - max(was, 0):
            moved[r] = more
            table.total += more
    return moved


def net(table: Pages | Small) -> Counter:
    return Counter({r: v[0] for r, v in table.items() if v[0] > 0})


class SumDelta(Delta):
    """Invertible aggregates: running sums of many keys; input rows are sums too, pre-combined before the shuffle.

    A call has the changed keys of one bucket of keys, reads and writes the pages of those keys alone, and yields one frame.
    """

    def __init__(self, aggregates: Sequence[Aggregate], parts: T.StructType):
        self.aggregates, self.parts, self.kinds = list(aggregates), parts.names, [f.dataType for f in parts.fields]
        self.at = [[(p, parts.names.index(f"p{i}_{p}")) for p in a.parts] for i, a in enumerate(self.aggregates)]
        self.names = [KEY, *[a.name for a in aggregates], SIGN]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums, self.read = self.paged(handle, "sums"), readers(self.kinds)
        self.whole = all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in self.kinds)  # JSON holds them as they are

    def _result(self, sums: Sequence[Any]) -> tuple | None:
        if sums[0] <= 0:
            return None
        return tuple([a.finish({p: sums[i] for p, i in at}) for a, at in zip(self.aggregates, self.at, strict=True)])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        change: dict[str, Sequence] = {}
        for frame in self.frames(rows):
            for k, *sums in zip(frame[KEY].tolist(), *(frame[p].tolist() for p in self.parts), strict=True):
                held = change.get(k)
                change[k] = sums if held is None else [a + b for a, b in zip(held, sums, strict=True)]
        table = self.table(self.sums, timerValues)
        yield from framed(self._emit(table, change), self.names)
        table.flush()

    def _emit(self, table: Pages, change: dict[str, Sequence]) -> Iterator[tuple]:
        nothing = [0] * len(self.parts)
        for k, sums in change.items():
            if not any(sums):
                continue
            held = table.get(k)
            last = nothing if held is None else held if self.whole else [f(v) for f, v in zip(self.read, held, strict=True)]
            current = [a + b for a, b in zip(last, sums, strict=True)] if held else sums
            table.put(k, (current if self.whole else [written(v) for v in current]) if any(current) else None)
            before, after = self._result(last), self._result(current)
            if before != after:
                if after is not None:
                    yield k, *after, 1
                if before is not None:
                    yield k, *before, -1


def sums_by(table: pa.Table, keys: Sequence[str], parts: Sequence[str]) -> pa.Table:
    """The sums of each key's parts, in their types; 64-bit integers are summed as decimals where they could overflow."""
    for i, p in enumerate(table.schema.names):
        if p in parts and pa.types.is_integer(table.schema.types[i]) and table.num_rows:
            ends = pc.min_max(table[p]).as_py()
            if max(abs(v or 0) for v in ends.values()) * table.num_rows >= 1 << 63:
                table = table.set_column(i, p, table[p].cast(pa.decimal128(19)))
    return table.group_by(list(keys), use_threads=False).aggregate([(p, "sum") for p in parts]).select([*keys, *[f"{p}_sum" for p in parts]]).rename_columns([*keys, *parts])


def differ(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.ChunkedArray:
    """Where two columns have other values, nulls counting as one."""
    return pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))


def some(table: pa.Table, names: Iterable[str]) -> pa.ChunkedArray:
    """Rows with a number that is not zero in one of the columns."""
    return functools.reduce(pc.or_, [pc.not_equal(table[n], pa.scalar(0, table[n].type)) for n in names])


class ColumnSums(Delta):
    """What SumDelta does, a bucket's keys at a time as Arrow columns: aggregates with a form for columns, integers and doubles.

    keys: the columns of a key, or its text alone.  A call reads and writes the pages that hold the changed keys; memory is a
    bucket's at most.
    """

    def __init__(self, aggregates: Sequence[Aggregate], keys: Sequence[str], parts: Sequence[str]):
        self.aggregates, self.keys, self.parts, self.summed = list(aggregates), list(keys), list(parts), tuple(parts)
        self.at = [{p: f"p{i}_{p}" for p in a.parts} for i, a in enumerate(self.aggregates)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "page int", "body binary")

    def _results(self, sums: pa.Table) -> list[pa.ChunkedArray]:
        return [a.columns({p: sums[c] for p, c in at.items()}) for a, at in zip(self.aggregates, self.at, strict=True)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        by = [HASH, *self.keys]
        change = pa.concat_tables([self.unpacked(f) for f in rows])
        if change.column(0).num_chunks > 1:  # a cell has each key once
            change = sums_by(change, by, self.parts).select(self.packed.names).cast(self.packed)
        change = change.filter(some(change, self.parts))
        if not change.num_rows:
            return
        table = ColumnPages(self.sums, self.packed, HASH)
        pages = table.pages_of(change[HASH])
        held = table.load(pages)
        more = [f"{p} more" for p in self.parts]
        none = lambda n: [pa.repeat(pa.scalar(0, self.packed.field(p).type), n) for p in self.parts]
        # each key's sums and what they change by; no sum adds up more than one row that is not zero
        both = pa.concat_tables([
            pa.Table.from_arrays([*(held[c] for c in (*by, *self.parts)), *none(held.num_rows)], [*by, *self.parts, *more]),
            pa.Table.from_arrays([*(change[c] for c in by), *none(change.num_rows), *(change[p] for p in self.parts)], [*by, *self.parts, *more]),
        ]).group_by(by, use_threads=False).aggregate([(p, "sum") for p in (*self.parts, *more)])
        before = both.select([*by, *[f"{p}_sum" for p in self.parts]]).rename_columns([*by, *self.parts])
        changes = [pc.add_checked(before[p], both[f"{p} more_sum"]) for p in self.parts]
        after = pa.Table.from_arrays([*(before[c] for c in by), *changes], [*by, *self.parts])
        table.store(pages, after.filter(some(after, self.parts)))
        moved = some(both, [f"{m}_sum" for m in more])
        yield from self._shown(before.filter(moved), after.filter(moved))

    def _shown(self, before: pa.Table, after: pa.Table) -> Iterator[pd.DataFrame]:
        """The rows that lead from the results of some sums to those of others, additions first."""
        results = [self._results(t) for t in (before, after)]
        there = [pc.greater(t[self.parts[0]], 0) for t in (before, after)]
        other = functools.reduce(pc.or_, [differ(a, b) for a, b in zip(*results, strict=True)], pc.xor(*there))
        names = [*self.keys, *[a.name for a in self.aggregates]]
        rows = [pa.Table.from_arrays([*(before[k] for k in self.keys), *results[i]], names).filter(pc.and_(other, there[i])) for i in (1, 0)]
        shown = pa.concat_tables([r.append_column(SIGN, pa.repeat(pa.scalar(sign, pa.int64()), r.num_rows)) for r, sign in zip(rows, (1, -1), strict=True)])
        for a in range(0, shown.num_rows, FRAME_ROWS):
            part = shown.slice(a, FRAME_ROWS).combine_chunks()
            yield pd.DataFrame({n: pd.arrays.ArrowExtensionArray(part[n]) for n in part.schema.names}, copy=False)


class Results:
    """Results of aggregates over the net rows of a group, given as weights of rows' texts."""

    def __init__(self, aggregates: Sequence[Aggregate], values: T.StructType):
        self.aggregates, self.kinds = list(aggregates), [f.dataType for f in values.fields]
        self.at = [values.names.index(a.value) if a.value else None for a in aggregates]

    def text(self, rows: Counter) -> str | None:
        """The text of the results; None for a group without net rows."""
        net = [(values_of(r, self.kinds), n) for r, n in rows.items() if n > 0]
        if not net:
            return None
        out = []
        for a, at in zip(self.aggregates, self.at, strict=True):
            counter: Counter = Counter()
            for r, n in net:
                counter[r[at] if at is not None else None] += n
            if a.multiset:
                out.append(a.finish(counter))
            else:
                known = [(v, n) for v, n in counter.items() if v is not None or a.value is None]
                out.append(a.finish(a.from_values(known)))
        return text_of_values(out)


class MultisetDelta(Delta):
    """Any aggregate: each group's rows with their weights; results are computed again from the net rows.

    A call has the changed groups of one bucket of keys.  A table's mark is the text of its last result.
    """

    names = (KEY, "out__", SIGN)

    def __init__(self, aggregates: Sequence[Aggregate], values: T.StructType):
        self.results = Results(aggregates, values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = self.owned(handle, "rows")

    def result(self, key: str, table: Pages | Small, moved: dict[str, int]) -> str | None:
        return self.results.text(net(table))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tables = self.tables(self.rows, timerValues)
        yield from framed(self._emit(tables, self.changes(rows)), self.names)
        tables.flush()

    def _emit(self, tables: Tables, changes: dict[str, dict[str, int]]) -> Iterator[tuple]:
        for k, change in changes.items():
            if not any(change.values()):
                continue
            table = tables.table(k)
            moved, before = apply(table, change), table.mark
            after = table.mark = self.result(k, table, moved)
            tables.close(k, table)
            if after != before:
                if after is not None:
                    yield k, after, 1
                if before is not None:
                    yield k, before, -1


class ExtremeDelta(MultisetDelta):
    """Smallest and largest values alone: beside the rows' weights, each column's values are sorted in a tree of state.

    An extreme that is taken back costs one way through the tree, however large the group is.  Groups of few rows have no tree.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sorted = handle.getMapState("sorted", "owner string, tree int, node int", "body string")

    def result(self, key: str, table: Pages | Small, moved: dict[str, int]) -> str | None:
        if isinstance(table, Small):
            if len(table.rows) <= SHARED_ROWS:
                return super().result(key, table, moved)
            moved = dict(net(table))  # the table grows now, and so do its trees
        columns, kinds = list(dict.fromkeys(self.results.at)), self.results.kinds
        values, trees = [(values_of(r, kinds), n) for r, n in moved.items()], {}
        for at in columns:
            changes: dict[str, tuple[str, int]] = {}
            for row, n in values:
                if row[at] is not None:
                    order = order_text(row[at])
                    changes[order] = (text_of_values([row[at]]), changes.get(order, ("", 0))[1] + n)
            trees[at] = Sorted(Owned(self.sorted, key), at)
            trees[at].change({k: v for k, v in changes.items() if v[1]})
        if table.total <= 0:
            return None
        texts = [trees[at].extreme(a.largest) for a, at in zip(self.results.aggregates, self.results.at, strict=True)]
        return text_of_values([None if t is None else values_of(t, [kinds[at]])[0] for t, at in zip(texts, self.results.at, strict=True)])


class TwoSided(Delta):
    """Both sides' rows with weights for each key; a key with a null meets nothing of the other side.

    A call has the changed keys of one bucket of keys.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = [self.owned(handle, n, i) for i, n in enumerate(("left", "right"))]

    def sides(self, timers: Any) -> list[Tables]:
        return [self.tables(s, timers, i) for i, s in enumerate(self.states)]

    def sided(self, rows: Iterator[pd.DataFrame]) -> dict[str, tuple[dict[str, int], dict[str, int], bool]]:
        """Of every key, the change of each side, and whether the key may meet."""
        change: dict[str, tuple] = {}
        for frame in self.frames(rows):
            for k, meets, side, r, sign in zip(*(frame[c].tolist() for c in (KEY, "meets__", "side__", ROW, SIGN)), strict=True):
                own = change.get(k)
                if own is None:
                    own = change[k] = ({}, {}, bool(meets))
                own[side][r] = own[side].get(r, 0) + sign
        return change


class JoinDelta(TwoSided):
    """Joins of any kind: what changed on one side meets the other side, old or changed, once each.

    how: inner, left, right, full, semi, anti.  Rows that stand alone come and go when the other side's first row does: whether
    there is one is a count that each side keeps.  A side's rows are looked up by what changes, and read whole
    only when the other side's change meets them.

    fixed: the side that is there before the stream begins, given as initial state.  Its rows that stand alone are
    shown by the first batch, by their keys' input or by a timer of buckets with keys that had none.
    """

    names = (KEY, "left__", "right__", SIGN)

    def __init__(self, how: str, fixed: int | None = None):
        self.how, self.fixed = how, fixed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def shows_alone(self, side: int) -> bool:
        """Whether rows of a side without a partner are shown."""
        return self.how in (("left", "full", "anti") if side == 0 else ("right", "full"))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        tables, marked = self.tables(self.states[self.fixed], timerValues, self.fixed), False
        for k, (*change, meets) in self.sided(iter([initialState])).items():
            table = tables.table(k)
            apply(table, change[self.fixed])
            if self.shows_alone(self.fixed) and table.mark is None:
                table.mark, marked = "meets" if meets else "null key", True  # of rows that no batch has shown yet
            tables.close(k, table)
        if marked:
            self.handle.registerTimer(1)  # long past: due in the batch that loads the state
        tables.flush()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.fixed is not None:
            yield from self._shown_by(self.sides(timerValues), None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self._shown_by(self.sides(timerValues), self.sided(rows))

    def _shown_by(self, sides: list[Tables], changes: dict[str, tuple] | None) -> Iterator[pd.DataFrame]:
        """What changes of a bucket's keys show; without changes, what its keys with a mark show."""

        emit = self._pairs if self.how == "inner" else self._emit

        def shown() -> Iterator[tuple]:
            for k in sides[self.fixed].keys() if changes is None else changes:
                *change, meets = changes[k] if changes else ({}, {}, True)
                if changes is not None and not any(change[0].values()) and not any(change[1].values()):
                    continue
                tables = [s.table(k) for s in sides]
                if changes is None:
                    if not tables[self.fixed].mark:
                        continue
                    meets = tables[self.fixed].mark == "meets"
                for row in emit(k, tables, change, meets):
                    if -LARGEST <= row[3] <= LARGEST:
                        yield row
                    else:
                        yield from in_parts(row)
                for s, t in zip(sides, tables, strict=True):
                    s.close(k, t)

        yield from framed(shown(), self.names)
        for s in sides:
            s.flush()

    @staticmethod
    def _pairs(key: str, tables: list[Pages | Small], change: list[dict[str, int]], meets: bool) -> Iterator[tuple]:
        """What changes of an inner join: each pair comes once, so none of them is kept."""
        left, right = (apply(t, c) if c else {} for t, c in zip(tables, change, strict=True))  # rows that count more or less than before
        if not meets or not (left or right):
            return
        now = [{r: v[0] for r, v in t.items() if v[0] > 0} if met else {} for t, met in zip(tables, (right, left), strict=True)]

        def pairs() -> Iterator[tuple]:
            for a, n in left.items():
                for b, m in now[1].items():
                    if b not in right:
                        yield a, b, n * m
            for b, m in right.items():
                for a, n in now[0].items():
                    if a not in left:
                        yield a, b, n * m
                for a, n in left.items():  # both have changed
                    x, y = now[0].get(a, 0), now[1].get(b, 0)
                    yield a, b, x * y - (x - n) * (y - m)

        if all(n > 0 for side in (left, right) for n in side.values()):
            yield from ((key, *p) for p in pairs())
        else:
            yield from ((key, *p) for p in pairs() if p[2] > 0)
            yield from ((key, *p) for p in pairs() if p[2] < 0)

    def _emit(self, key: str, tables: list[Pages | Small], change: list[dict[str, int]], meets: bool) -> Iterator[tuple]:
        before = [self._size(t) for t in tables]
        moved = [apply(t, c) for t, c in zip(tables, change, strict=True)]
        if self.fixed is not None and tables[self.fixed].mark:  # all that is there counts as new
            moved[self.fixed], before[self.fixed] = dict(net(tables[self.fixed])), 0
            tables[self.fixed].mark = None
        after = [self._size(t) for t in tables]
        out: Counter = Counter()
        if meets and self.how not in ("semi", "anti"):
            if moved[0]:
                for b, m in net(tables[1]).items():
                    for a, n in moved[0].items():
                        out[a, b] += n * m
            if moved[1]:
                for a, n in self._old(tables[0], moved[0]).items():
                    for b, m in moved[1].items():
                        out[a, b] += n * m
        if self.how == "semi" or self.shows_alone(0):
            alone = self.how != "semi"
            shown = lambda n: (n > 0 and meets) != alone
            out.update({(r, None): n for r, n in self._shown(tables[0], moved[0], shown(before[1]), shown(after[1])).items()})
        if self.shows_alone(1):
            alone_right = lambda n: not (n > 0 and meets)
            out.update({(None, r): n for r, n in self._shown(tables[1], moved[1], alone_right(before[0]), alone_right(after[0])).items()})
        yield from ((key, *r, n) for r, n in out.items() if n > 0)
        yield from ((key, *r, n) for r, n in out.items() if n < 0)

    @staticmethod
    def _size(table: Pages | Small) -> int:
        """How many rows a side counts: kept as a number unless rows are forgotten."""
        return table.total if table.ttl is None else sum(net(table).values())

    @staticmethod
    def _old(table: Pages | Small, moved: dict[str, int]) -> Counter:
        """What a side counted before it changed."""
        old = net(table)
        for r, n in moved.items():
            old[r] -= n
        return Counter({r: n for r, n in old.items() if n})

    def _shown(self, table: Pages | Small, moved: dict[str, int], before: bool, after: bool) -> dict[str, int]:
        """How the rows shown by themselves change, given whether they were and are shown."""
        if before and after:
            return moved
        if after:
            return dict(net(table))
        return {r: -n for r, n in self._old(table, moved).items()} if before else {}


def listed(rows: Counter) -> str | None:
    """A text that lists rows' texts; None for no rows."""
    return "[" + ",".join(r for r in sorted(rows) for _ in range(rows[r])) + "]" if rows else None


class CogroupDelta(TwoSided):
    """Both sides' net rows of a key as one row with two lists of rows' texts."""

    names = (KEY, "left__", "right__", SIGN)

    def _result(self, left: Counter, right: Counter, meets: bool) -> Counter:
        a, b = listed(left), listed(right)
        if meets:
            return Counter({(a, b): 1}) if a or b else Counter()
        return Counter({r: 1 for r in ((a, None), (None, b)) if any(r)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        sides = self.sides(timerValues)
        yield from framed(self._emit(sides, self.sided(rows)), self.names)
        for s in sides:
            s.flush()

    def _emit(self, sides: list[Tables], changes: dict[str, tuple]) -> Iterator[tuple]:
        for k, (*change, meets) in changes.items():
            tables = [s.table(k) for s in sides]
            last = [net(t) for t in tables]
            for t, c in zip(tables, change, strict=True):
                apply(t, c)
            yield from delta(k, self._result(*last, meets), self._result(*[net(t) for t in tables], meets))
            for s, t in zip(sides, tables, strict=True):
                s.close(k, t)


class WindowCogroup(TwoSided):
    """A cogroup whose `side` has tumbling windows of `size` rows: one row for each window, beside all rows of the other side.

    The other side's rows may be taken back; each of them belongs to every window of its key, closed ones too, so every
    window's row is replaced when that side changes.  Without a window yet, the other side's rows stand alone.
    """

    names = (KEY, "window_id", "left__", "right__", SIGN)

    def __init__(self, side: int, size: int):
        self.side, self.size = side, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "window_id long, n long", self.ttls[self.side])
        self.windows = handle.getMapState("windows", "window_id long", "rows string", self.ttls[self.side])
        self.other = self.paged(handle, "other", 1 - self.side)

    def _rows(self, windows: dict[int, list[str]], other: Counter, meets: bool) -> Counter:
        order = (lambda a, b: (a, b)) if self.side == 0 else (lambda a, b: (b, a))
        beside = listed(other)
        out = Counter({(i, *order(listed(Counter(w)), beside if meets else None)): 1 for i, w in windows.items() if w})
        if beside and not (windows and meets):
            out[(None, *order(None, beside))] += 1
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived, change, meets = [], Counter(), True
        for frame in self.frames(rows):
            meets = bool(frame["meets__"].iloc[0])
            for side, r, sign in zip(frame["side__"].tolist(), frame[ROW].tolist(), frame[SIGN].tolist(), strict=True):
                if side != self.side:
                    change[r] += sign
                elif sign < 0:
                    raise ValueError("count windows take insert-only input")
                else:
                    arrived += [r] * int(sign)
        table = self.table(self.other, timerValues, 1 - self.side)
        window_id, n = self.place.get() or (0, 0)
        beside = net(table)
        moved = apply(table, Counter({r: n for r, n in change.items() if n}))
        if moved:  # every window's row changes
            before = {k[0]: json.loads(v[0]) for k, v in self.windows.iterator()}
        else:
            before = {window_id: json.loads(self.windows.getValue((window_id,))[0])} if n else {}
            if window_id and not n:
                before[-1] = []  # closed windows are there, and stay as they are
        after = {i: list(w) for i, w in before.items()}
        for r in arrived:
            after.setdefault(window_id, []).append(r)
            n += 1
            if n == self.size:
                window_id, n = window_id + 1, 0
        for i, w in after.items():
            if w != before.get(i):
                self.windows.updateValue((i,), (json.dumps(w, ensure_ascii=False),))
        if arrived:
            self.place.update((window_id, n))
        out = delta(key[0], self._rows(before, beside, meets), self._rows(after, net(table), meets))
        table.flush()
        if out:
            yield signed_frame(out, self.names)


class CountWindow(Delta):
    """Tumbling windows of `size` rows for each key: the open window's result is running, a full one is final.

    Insert-only input, in the order of arrival.  State is the open window alone.
    """

    names = (KEY, "window_id", "out__", SIGN)

    def __init__(self, size: int, aggregates: Sequence[Aggregate], values: T.StructType):
        self.size, self.results = size, Results(aggregates, values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "window_id long, n long", self.ttls[0])
        self.rows = handle.getValueState("rows", "body string", self.ttls[0])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        window_id, n = self.place.get() or (0, 0)
        held = self.rows.get()
        open_rows = Counter(json.loads(held[0])) if held else Counter()
        result = lambda: Counter({(window_id, text): 1}) if (text := self.results.text(open_rows)) is not None else Counter()
        before, after = result(), Counter()
        for frame in self.frames(rows):
            for r, sign in zip(frame[ROW].tolist(), frame[SIGN].tolist(), strict=True):
                if sign < 0:
                    raise ValueError("count windows take insert-only input")
                for _ in range(int(sign)):
                    open_rows[r] += 1
                    n += 1
                    if n == self.size:
                        after.update(result())
                        window_id, n, open_rows = window_id + 1, 0, Counter()
        after.update(result())
        self.rows.update((json.dumps(open_rows, ensure_ascii=False),))
        self.place.update((window_id, n))
        out = delta(key[0], before, after)
        if out:
            yield signed_frame(out, self.names)
