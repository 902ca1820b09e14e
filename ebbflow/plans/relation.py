"""A relation is a signed frame with a name; its operators choose the batch or the streaming form by the frame."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import redirect_stdout
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.operators import relational
from ebbflow.operators.aggregates import Aggregate
from ebbflow.signed import SIGN, columns, positive
from ebbflow.streaming import lowering
from ebbflow.streaming.run import net, run_available


@dataclass(frozen=True)
class Options:
    """Options of an alias: shuffle its input before it, how parallel it is, its count window, its state's life.

    A group with `parallel` is dealt once, by its keys: a batch over that many partitions, a stream's sums over that many
    buckets of keys, which the run's state partitions share.  A load with `parallel` or a shuffle deals its rows over so many
    tasks, whatever number of partitions its source has.  ttl_ms: state that nothing touched for so long is dropped (by the
    clock); input_ttl_ms and windows say it for single inputs of a join or cogroup, by index from 0.  native: an inner join
    of two streams by Spark's own operator, for keys with more different rows than a worker should hold.
    """

    shuffle_before: bool = False
    parallel: int | None = None
    window: int | None = None
    ttl_ms: int | None = None
    input_ttl_ms: dict[int, int] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)
    native: bool = False

    @property
    def ttls(self) -> tuple[int | None, int | None]:
        """The life of each input's state."""
        return self.input_ttl_ms.get(0, self.ttl_ms), self.input_ttl_ms.get(1, self.ttl_ms)


@dataclass(frozen=True)
class Relation:
    """df: signed rows; ops: what led here, for explain; insert_only: no row is ever taken back; windowed: a count window's."""

    df: DataFrame
    alias: str
    ops: tuple[tuple[str, str, str], ...] = ()
    insert_only: bool = True
    options: dict[str, Options] = field(default_factory=dict)
    windowed: bool = False

    @staticmethod
    def load(df: DataFrame, alias: str, options: dict[str, Options] | None = None) -> Relation:
        """A batch or streaming frame; a sign column that it has already is kept.  The alias may have options as well."""
        names = columns(df)
        if len(set(names)) != len(names):
            raise ValueError(f"{alias}: column names must be unique: {names}")
        came = Relation(positive(df), alias, (("LOAD", alias, "stream" if df.isStreaming else "static"),), SIGN not in df.columns, options or {})
        return replace(came, df=came._dealt(alias))

    def _next(self, df: DataFrame, kind: str, alias: str, note: str = "", insert_only: bool | None = None, *others: Relation) -> Relation:
        ops = self.ops + tuple(o for r in others for o in r.ops if o not in self.ops) + ((kind, alias, note),)
        return replace(self, df=df, alias=alias, ops=ops, windowed=kind == "WINDOW" or (self.windowed and kind in ("FILTER", "FOREACH")), insert_only=self.insert_only if insert_only is None else insert_only, options={**self.options, **{k: v for r in others for k, v in r.options.items()}})

    def _own(self, alias: str) -> Options:
        return self.options.get(alias, Options())

    def _dealt(self, alias: str, keys: Sequence[str] = ()) -> DataFrame:
        own = self._own(alias)
        if own.parallel and keys and not own.shuffle_before:
            return self.df if self.streaming else self.df.repartition(own.parallel, *keys)
        if own.shuffle_before or own.parallel:
            return self.df.repartition(own.parallel or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return self.df

    @property
    def streaming(self) -> bool:
        return self.df.isStreaming

    def filter(self, condition: str | Column, alias: str) -> Relation:
        """Rows for which the condition is true."""
        return self._next(self._dealt(alias).filter(condition), "FILTER", alias)

    def foreach(self, alias: str, *exprs: str | Column) -> Relation:
        """Expressions of each row; the sign goes along."""
        cols = [F.expr(e) if isinstance(e, str) else e for e in exprs]
        return self._next(self._dealt(alias).select(*cols, SIGN), "FOREACH", alias)

    def map_batches(self, alias: str, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Relation:
        """A user's function over Arrow batches of the signed rows; what it yields has the columns of schema and the sign."""
        return self._next(self._dealt(alias).mapInArrow(function, f"{schema}, {SIGN} int"), "MAP", alias)

    def observe(self, alias: str) -> Relation:
        """Count additions and retractions as they pass: `lastProgress` and listeners have them under the alias."""
        seen = self.df.observe(alias, F.sum(F.when(F.col(SIGN) > 0, F.col(SIGN)).otherwise(0)).alias("added"), F.sum(F.when(F.col(SIGN) < 0, -F.col(SIGN)).otherwise(0)).alias("taken_back"))
        return self._next(seen, "OBSERVE", alias)

    def flatten(self, alias: str, bag: str | Column, name: str, *keep: str) -> Relation:
        """One row for each element of an array (an empty one drops its row), beside the columns to keep."""
        value = F.col(bag) if isinstance(bag, str) else bag
        return self._next(self._dealt(alias).select(*keep, F.explode(value).alias(name), SIGN), "FLATTEN", alias)

    def flatten_tuple(self, alias: str, column: str, *keep: str) -> Relation:
        """A struct's fields as columns."""
        return self._next(self._dealt(alias).select(*keep, f"{column}.*", SIGN), "FLATTEN", alias, "tuple")

    def positional(self, i: int) -> Column:
        """The i-th user column, from 0."""
        return F.col(f"`{columns(self.df)[i]}`")

    def group(self, alias: str, keys: Sequence[str], *aggregates: Aggregate) -> Relation:
        """Grouped aggregates; no keys: one group of all rows.  With a window option, count windows of each key."""
        own = self._own(alias)
        if own.window:
            if not self.streaming:
                raise ValueError("batch count windows need an order: use count_window")
            return self.count_window(alias, keys, own.window, *aggregates)
        df = self._dealt(alias, keys)
        if self.streaming:
            state = "sums" if all(a.parts is not None for a in aggregates) else "multiset"
            return self._next(lowering.group(df, keys, aggregates, own.ttl_ms, own.parallel or lowering.BUCKETS), "GROUP", alias, f"state={state}", False)
        return self._next(relational.group(df, keys, aggregates, self.insert_only), "GROUP", alias, "", True)

    def count_window(self, alias: str, keys: Sequence[str], size: int, *aggregates: Aggregate, order: Sequence[str | Column] = ()) -> Relation:
        """Tumbling windows of `size` rows for each key; a batch numbers them by `order`, a stream by arrival."""
        if not self.insert_only:
            raise ValueError("count windows take insert-only input")
        if self.streaming:
            return self._next(lowering.count_window(self._dealt(alias), keys, size, aggregates, self._own(alias).ttl_ms), "WINDOW", alias, f"rows={size}", False)
        if not order:
            raise ValueError("batch count windows need an order")
        return self._next(relational.count_window(self._dealt(alias), keys, order, size, aggregates), "WINDOW", alias, f"rows={size}", True)

    def join(self, alias: str, other: Relation, on: Sequence[str], how: str = "inner", replicated: bool = False) -> Relation:
        """Equi-join of two relations, batch or streaming in any combination that the kind of join allows."""
        if self.windowed and other.windowed:
            raise ValueError(f"{alias}: only one side of a join may have a count window")
        if self.streaming or other.streaming:
            right = other.df
            if replicated and not other.streaming and relational.size_bound(right) <= 64 << 20:
                right = F.broadcast(right)
            out = lowering.join(self._dealt(alias), right, on, how, self._own(alias).native or None, self._own(alias).ttls)
        else:
            out = relational.join(self._dealt(alias), other.df, on, how, replicated, insert_only=self.insert_only and other.insert_only)
        kept = self.insert_only and other.insert_only and (not out.isStreaming or lowering.stateless(self.df, other.df, how))
        return self._next(out, "JOIN", alias, f"{how}{', replicated' if replicated else ''}", kept, other)

    def cogroup(self, alias: str, other: Relation, on: Sequence[str], order: Sequence[str | Column] = ()) -> Relation:
        """Both sides' rows of each key as arrays; at most one side may come from a count window.

        With the option `windows`, one side has count windows: a row for each key and window_id, beside all rows of the other
        side.  A batch numbers the windowed side by `order`, a stream by arrival.
        """
        own, inputs = self._own(alias), (self, other)
        if self.windowed and other.windowed or len(own.windows) > 1:
            raise ValueError(f"{alias}: only one side of a group may have a count window")
        if any(not inputs[i].insert_only for i in own.windows):
            raise ValueError("count windows take insert-only input")
        note = ", ".join(f"input {i}: rows={n}" for i, n in own.windows.items())
        if self.streaming or other.streaming:
            return self._next(lowering.cogroup(self._dealt(alias), other.df, on, ttls=own.ttls, windows=own.windows), "COGROUP", alias, note, False, other)
        if own.windows and not order:
            raise ValueError("batch count windows need an order")
        out = relational.cogroup(self._dealt(alias, on), other.df, on, insert_only=self.insert_only and other.insert_only, windows=own.windows, order=order)
        return self._next(out, "COGROUP", alias, note, True, other)

    def count_each(self, alias: str, keys: Sequence[str], element: str, name: str = "n", flat: bool = True) -> Relation:
        """How often each element occurs in its group: a row each, or an array of (element, n) for each group."""
        if self.streaming:
            return self._next(lowering.count_each(self._dealt(alias, keys), keys, element, name, flat, self._own(alias).ttl_ms, self._own(alias).parallel or lowering.BUCKETS), "COUNT_EACH", alias, "", False)
        return self._next(relational.count_each(self._dealt(alias, keys), keys, element, name, flat), "COUNT_EACH", alias, "", True)

    def union(self, alias: str, *others: Relation) -> Relation:
        """Bag union."""
        return self._next(relational.union(self._dealt(alias), *[o.df for o in others]), "UNION", alias, "", self.insert_only and all(o.insert_only for o in others), *others)

    def distinct(self, alias: str) -> Relation:
        """Each net row once."""
        df = self._dealt(alias, columns(self.df))
        out = lowering.distinct(df, self._own(alias).ttl_ms, self._own(alias).parallel or lowering.BUCKETS) if self.streaming else relational.distinct(df)
        return self._next(out, "DISTINCT", alias, "", False if self.streaming else True)

    def rows(self, state_partitions: int | None = None) -> DataFrame:
        """The result as plain rows: a stream is run over all its input and netted, with its state in a part for each core."""
        if self.streaming:
            return net(run_available(self.df, state_partitions=state_partitions or self.df.sparkSession.sparkContext.defaultParallelism))
        return self.df.drop(SIGN) if self.insert_only else net(self.df)

    def describe(self) -> str:
        """The operators that led here, one a line: kind, alias, notes."""
        return "\n".join(" ".join(x for x in (k, a, n) if x) for k, a, n in self.ops)

    def explain(self, mode: str = "formatted") -> str:
        """describe() and Spark's plan."""
        with redirect_stdout(io.StringIO()) as out:
            self.df.explain(mode)
        return f"{self.describe()}\n{out.getvalue()}"
