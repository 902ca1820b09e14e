"""Streaming forms of the grouped operators, over streaming frames with a sign column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from ebbflow.operators.aggregates import Aggregate, count
from ebbflow.signed import SIGN, columns, consolidate, positive
from ebbflow.streaming.codec import fields_of, rows_of, text_of
from ebbflow.streaming.processors import BUCKET, HASH, KEY, PACKED, ROW, CogroupDelta, ColumnSums, CountWindow, Delta, ExtremeDelta, JoinDelta, MultisetDelta, SumDelta, WindowCogroup, sums_by
from ebbflow.streaming.run import replay

#: Buckets that the keys of invertible aggregates are called by: many keys a call.  A checkpoint holds for one number.
BUCKETS = 1024
#: Parts that the rows of a key with extremes are dealt over.
PARTS = 256
#: Rows, and bytes, that a task sums by key or packs by bucket at a time before the shuffle; most rows of a packed cell, and its
#: bytes by the mean row.
COMBINE_ROWS, COMBINE_BYTES, PACKED_ROWS, PACKED_BYTES = 1 << 19, 32 << 20, 4096, 32 << 10


def _fields(df: DataFrame, names: Sequence[str]) -> StructType:
    return StructType([df.schema[n] for n in names])


def _kinds(aggregates: Sequence[Aggregate]) -> StructType:
    return StructType([StructField(a.name, StructType.fromDDL(f"x {a.kind}")["x"].dataType) for a in aggregates])


def _sums(keys: Sequence[str], parts: Sequence[str], whole: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of equal keys' parts, over many Arrow batches; `whole` has them when they are many, and at the end."""

    def summed(held: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(held)
        return sums_by(table, keys, parts).select(table.schema.names).cast(table.schema) if parts else table

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= COMBINE_ROWS or size >= COMBINE_BYTES:
                held = [summed(held)]
                if not parts or held[0].num_rows > COMBINE_ROWS // 2 or held[0].nbytes > COMBINE_BYTES // 2:
                    yield from whole(held.pop())
                rows, size = sum(t.num_rows for t in held), sum(t.nbytes for t in held)
        if held:
            yield from whole(summed(held))

    return sums


def _pack(schema: pa.Schema, parts: Sequence[str] = (SIGN,)) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of each bucket, many to a cell: Spark takes single rows to a state processor one by one in Python.

    Equal rows are one with the sums of their parts: with signs, one row with its weight.
    """

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = table[BUCKET].to_numpy()
        order = np.argsort(bucket.astype(np.uint16) if len(bucket) and 0 <= bucket.min() and bucket.max() < 1 << 16 else bucket, kind="stable")
        bucket = bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        rows, = table.select(schema.names).cast(schema).combine_chunks().take(order).combine_chunks().to_batches()
        most = max(1, min(PACKED_ROWS, PACKED_BYTES * rows.num_rows // max(1, rows.nbytes)))
        bounds = [(i, min(i + most, b)) for a, b in pairwise(cuts) for i in range(a, b, most)]
        for i in range(0, len(bounds), 500):
            some = bounds[i : i + 500]
            cells = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in some]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in some], pa.int64()), pa.array(cells, pa.binary())], names=[BUCKET, PACKED])

    parts = [p for p in parts if p in schema.names]
    return _sums([n for n in (BUCKET, *schema.names) if n not in parts], parts, packed)


Ttls = Sequence[int | None]
FOREVER: Ttls = (None, None)


def stateful(df: DataFrame, by: str, processor: Delta, schema: str | StructType, ttls: Ttls = FOREVER, initial: DataFrame | None = None) -> DataFrame:
    """Append mode: such operators can follow each other in one stream.  ttls: milliseconds for each input, by the clock.

    initial: rows, with the columns of df, that are state before the stream begins.
    """
    if by == BUCKET:
        fields = StructType([f for f in df.schema if f.name != BUCKET])
        processor.packed = to_arrow_schema(fields)
        df, initial = (d if d is None else d.select(BUCKET, *fields.names).mapInArrow(_pack(processor.packed, processor.summed), f"{BUCKET} long, {PACKED} binary") for d in (df, initial))
    processor.inputs, processor.ttls = df.columns, ttls
    mode = "ProcessingTime" if any(ttls) or initial is not None else "None"
    out = df.groupBy(by).transformWithStateInPandas(processor, schema, "Append", mode, initial.select(*df.columns).groupBy(by) if initial is not None else None)
    return out.withColumn(SIGN, F.col(SIGN).cast("int"))


#: Types of keys that Arrow groups by.
PLAIN = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType, StringType, BinaryType, DateType, TimestampType, TimestampNTZType)


def _combine(keys: list[str], parts: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum the parts of equal keys of many Arrow batches: less to shuffle, few rows for a hot key."""
    return _sums(keys, parts, lambda table: iter(table.to_batches(max_chunksize=10_000)))


#: Types of numbers that sums are kept of as 64-bit integers; a key that is kept as its text.
INTEGERS, TEXT = (ByteType, ShortType, IntegerType, LongType), StructType([StructField(KEY, StringType())])


def _keyed(df: DataFrame, keys: StructType) -> DataFrame:
    return df.withColumn(KEY, text_of(keys))


def _bucketed(df: DataFrame, *by: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows beside the bucket that a state processor is called for."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*(by or (KEY,))), F.lit(buckets)))


def group(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate], ttl: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Grouped aggregation that emits differences: sums if all aggregates are invertible, else the group's multiset.

    Sums are kept by buckets of keys, which are dealt once: so many tasks can work at a time, whatever the run's partitions.
    """
    df, key = positive(df), _fields(df, list(keys))
    if all(a.parts is not None for a in aggregates):
        parts: dict[str, Column] = {"__rows": F.col(SIGN).cast("long")}
        for i, a in enumerate(aggregates):
            parts |= {f"p{i}_{p}": make() for p, make in a.parts.items()}
        return _summed(df, key, aggregates, parts, ttl, buckets)
    _check_values(aggregates)
    values = _fields(df, list(dict.fromkeys(a.value for a in aggregates if a.value)))
    rows = _keyed(df, key).select(KEY, text_of(values).alias(ROW), F.col(SIGN).cast("long").alias(SIGN))
    ordered = ttl is None and all(a.extreme for a in aggregates)  # rows that are forgotten leave no trace in an order
    shown, kinds = f"{KEY} string, out__ string, {SIGN} long", _kinds(aggregates)
    if ordered:
        # a key's rows are dealt over parts by their values, and the extremes of its parts are grouped again: no call has all rows of a key
        part = F.concat_ws("\t", KEY, F.pmod(F.xxhash64(ROW), F.lit(PARTS)).cast("string"))  # a key's text holds no tab
        parts = stateful(_bucketed(rows.withColumn(KEY, part), buckets=buckets), BUCKET, ExtremeDelta(aggregates, values), shown, (ttl, ttl))
        rows = parts.select(F.substring_index(KEY, "\t", 1).alias(KEY), F.col("out__").alias(ROW), F.col(SIGN).cast("long").alias(SIGN))
        processor: Delta = ExtremeDelta([replace(a, value=a.name) for a in aggregates], kinds)
    else:
        processor = MultisetDelta(aggregates, values)
    out = stateful(_bucketed(rows, buckets=buckets), BUCKET, processor, shown, (ttl, ttl))
    return out.select(*fields_of(F.col(KEY), key), *fields_of(F.col("out__"), kinds), SIGN)


def _summed(df: DataFrame, key: StructType, aggregates: Sequence[Aggregate], parts: dict[str, Column], ttl: int | None, buckets: int) -> DataFrame:
    """Running sums of keys, as Arrow columns where types and aggregates have that form, else key by key."""
    plain = StructType([StructField(f"k{i}__", f.dataType) for i, f in enumerate(key.fields)])
    typed = [F.col(f"`{f.name}`").alias(n) for f, n in zip(key.fields, plain.names, strict=True)]
    kinds = [f.dataType for f in df.select(*[c.alias(n) for n, c in parts.items()]).schema.fields]
    whole = ttl is None and all(a.columns for a in aggregates) and all(isinstance(k, (*INTEGERS, DoubleType)) for k in kinds)
    if whole:
        parts = {n: c.cast("long") if isinstance(k, INTEGERS) else c for (n, c), k in zip(parts.items(), kinds, strict=True)}
    sums = [c.alias(n) for n, c in parts.items()]
    if whole and key.names and all(isinstance(f.dataType, (BooleanType, *INTEGERS)) or f.dataType == StringType() for f in key.fields):
        combined, by = df.select(*typed, *sums), plain  # summed where they are packed
    elif key.names and all(isinstance(f.dataType, PLAIN) for f in key.fields):  # the text of a key is made once its rows are summed
        rows = df.select(*typed, *sums)
        combined, by = _keyed(rows.mapInArrow(_combine(plain.names, list(parts)), rows.schema), plain).select(KEY, *parts), TEXT
    else:
        rows = _keyed(df, key).select(KEY, *sums)
        combined, by = rows.mapInArrow(_combine([KEY], list(parts)), rows.schema), TEXT
    shown = StructType([*by, *_kinds(aggregates), StructField(SIGN, LongType())])
    processor = ColumnSums(aggregates, by.names, list(parts)) if whole else SumDelta(aggregates, _fields(combined, list(parts)))
    if whole:
        combined = combined.withColumn(HASH, F.shiftright(F.xxhash64(*by.names), 32).cast("int"))
    out = stateful(_bucketed(combined, *by.names, buckets=buckets), BUCKET, processor, shown, (ttl, ttl))
    keys = fields_of(F.col(KEY), key) if by is TEXT else [F.col(n).alias(f.name) for f, n in zip(key.fields, by.names, strict=True)]
    return out.select(*keys, *[f"`{a.name}`" for a in aggregates], SIGN)


def stateless(left: DataFrame, right: DataFrame, how: str) -> bool:
    """Whether rows of the stream meet a side that never changes, so that no row is ever taken back."""
    if how == "inner":
        return True
    if left.isStreaming and not right.isStreaming:
        return how in ("left", "semi", "anti")
    return right.isStreaming and not left.isStreaming and how == "right"


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", native: bool | None = None, ttls: Ttls = FOREVER) -> DataFrame:
    """Equi-join with at least one streaming side; how as in the batch form.

    Inner joins beside a static side, and joins that keep the rows of a stream beside one, are Spark's own (weights multiply).
    All others, joins of streams whose rows have a time to live, and native=False keep both sides' rows for each key
    and emit differences, so a null-extended row is taken back when its first partner comes; a static side then is the
    state that the stream begins with.  native=True has Spark's own for inner joins of two streams too, which takes some calls to
    its store for each row, and never holds all rows of a key.
    """
    left, right, on = positive(left), positive(right), list(on)
    streams = left.isStreaming and right.isStreaming
    forgets = any(ttls) and streams
    if (native or native is None and not streams) and not forgets and stateless(left, right, how):
        if how in ("semi", "anti"):
            return left.join(_netted(right.select(*on, SIGN)).select(*on), on, f"left_{how}")
        if how != "inner":
            left, right = (df if df.isStreaming else _netted(df) for df in (left, right))
        out = left.join(right.withColumnRenamed(SIGN, "__other"), on, how)
        return out.withColumn(SIGN, (F.coalesce(SIGN, F.lit(1)) * F.coalesce("__other", F.lit(1))).cast("int")).drop("__other")
    key = _fields(left, on)
    sides = [_fields(df, [c for c in columns(df) if c not in on]) for df in (left, right)]
    fixed = 0 if not left.isStreaming else 1 if not right.isStreaming else None
    out = _two_sided(left, right, key, sides, JoinDelta(how, fixed), ttls)
    shown = fields_of(F.col("left__"), sides[0]) + ([] if how in ("semi", "anti") else fields_of(F.col("right__"), sides[1]))
    return out.select(*fields_of(F.col(KEY), key), *shown, SIGN)


def _netted(df: DataFrame) -> DataFrame:
    return consolidate(df).filter(F.col(SIGN) > 0)


def _check_values(aggregates: Sequence[Aggregate]) -> None:
    for a in aggregates:
        if not a.multiset and a.from_values is None:
            raise ValueError(f"{a.name}: where all values are kept, an invertible aggregate must say how to sum them")


def _two_sided(left: DataFrame, right: DataFrame, key: StructType, sides: Sequence[StructType], processor: Delta, ttls: Ttls, shown: str = "") -> DataFrame:
    meets = F.lit(True)
    for k in key.names:
        meets = meets & F.col(f"`{k}`").isNotNull()
    tagged = [_keyed(df, key).select(KEY, meets.alias("meets__"), F.lit(i).alias("side__"), text_of(s).alias(ROW), F.col(SIGN).cast("long").alias(SIGN)) for i, (df, s) in enumerate(zip((left, right), sides, strict=True))]
    by = KEY
    if not isinstance(processor, WindowCogroup):
        by, tagged = BUCKET, [_bucketed(t) for t in tagged]
    live, still = [t for t in tagged if t.isStreaming], [t for t in tagged if not t.isStreaming]
    schema = f"{KEY} string, {shown}left__ string, right__ string, {SIGN} long"
    if still and isinstance(processor, JoinDelta):
        return stateful(live[0], by, processor, schema, ttls, still[0])
    # any other static side comes in with the first batch
    rows = live[0] if len(live) == 1 else live[0].unionByName(live[1])
    for t in still:
        rows = rows.unionByName(replay(t, 1))
    return stateful(rows, by, processor, schema, ttls)


def cogroup(left: DataFrame, right: DataFrame, on: Sequence[str], left_bag: str = "left_rows", right_bag: str = "right_rows", ttls: Ttls = FOREVER, windows: dict[int, int] | None = None) -> DataFrame:
    """One row for each key with both sides' net rows as arrays; it is replaced when a side changes.

    windows: by input index, the count window of one side: one row for each key and window_id then, each beside all of the other
    side's net rows.
    """
    left, right, on = positive(left), positive(right), list(on)
    key = _fields(left, on)
    sides = [_fields(df, [c for c in columns(df) if c not in on]) for df in (left, right)]
    bags = lambda out: (rows_of(F.col("left__"), sides[0]).alias(left_bag), rows_of(F.col("right__"), sides[1]).alias(right_bag))
    if windows:
        (side, size), = windows.items()
        out = _two_sided(left, right, key, sides, WindowCogroup(side, size), ttls, "window_id long, ")
        return out.select(*fields_of(F.col(KEY), key), "window_id", *bags(out), SIGN)
    out = _two_sided(left, right, key, sides, CogroupDelta(), ttls)
    return out.select(*fields_of(F.col(KEY), key), *bags(out), SIGN)


def count_each(df: DataFrame, keys: Sequence[str], element: str, name: str = "n", flat: bool = True, ttl: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """How often each element occurs in its group: a row each, or an array of (element, n) for each group."""
    counted = group(df, [*keys, element], [count(name)], ttl, buckets)
    if flat:
        return counted
    key, rest = _fields(counted, list(keys)), _fields(counted, [element, name])
    rows = _keyed(counted, key).select(KEY, F.lit(True).alias("meets__"), F.lit(0).alias("side__"), text_of(rest).alias(ROW), F.col(SIGN).cast("long").alias(SIGN))
    out = stateful(_bucketed(rows, buckets=buckets), BUCKET, CogroupDelta(), f"{KEY} string, left__ string, right__ string, {SIGN} long", (ttl, ttl))
    return out.select(*fields_of(F.col(KEY), key), rows_of(F.col("left__"), rest).alias(name), SIGN)


def distinct(df: DataFrame, ttl: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Each net row once: emitted when its weight becomes positive, taken back when it no longer is."""
    once = Aggregate("__n", None, "long", count().batch, count().parts, lambda s: 1, columns=lambda s: pc.if_else(pc.is_valid(s["n"]), 1, 1))
    return group(df, columns(df), [once], ttl, buckets).drop("__n")


def count_window(df: DataFrame, keys: Sequence[str], size: int, aggregates: Sequence[Aggregate], ttl: int | None = None) -> DataFrame:
    """Tumbling windows of `size` rows for each key, in the order of arrival."""
    _check_values(aggregates)
    df, key = positive(df), _fields(df, list(keys))
    values = _fields(df, list(dict.fromkeys(a.value for a in aggregates if a.value)))
    rows = _keyed(df, key).select(KEY, text_of(values).alias(ROW), F.col(SIGN).cast("long").alias(SIGN))
    out = stateful(rows, KEY, CountWindow(size, aggregates, values), f"{KEY} string, window_id long, out__ string, {SIGN} long", (ttl, ttl))
    return out.select(*fields_of(F.col(KEY), key), "window_id", *fields_of(F.col("out__"), _kinds(aggregates)), SIGN)
