"""Batch forms over signed frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.operators.aggregates import Aggregate
from ebbflow.session import shared_folder
from ebbflow.signed import SIGN, columns, consolidate, net_rows, positive


def group(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate], insert_only: bool = False) -> DataFrame:
    """One row of weight 1 for each group with net rows.

    Sums are taken over signed rows directly.  Aggregates over the multiset see net rows: frames that may hold
    retractions are netted first, which pre-aggregates by key and value.
    """
    df = positive(df)
    if any(a.multiset for a in aggregates) and not insert_only:
        wanted = list(dict.fromkeys([*keys, *[a.value for a in aggregates if a.value]]))
        df = consolidate(df.select(*wanted, SIGN)).filter(F.col(SIGN) > 0)
    out = df.groupBy(*keys).agg(F.sum(SIGN).alias("__n"), *[a.batch().alias(a.name) for a in aggregates])
    return out.filter(F.col("__n") > 0).select(*keys, *[a.name for a in aggregates], F.lit(1).alias(SIGN))


def count_each(df: DataFrame, keys: Sequence[str], element: str, name: str = "n", flat: bool = True) -> DataFrame:
    """How often each element occurs in its group: a row each, or (flat=False) an array of (element, n) for each group."""
    rows = positive(df).groupBy(*keys, element).agg(F.sum(SIGN).cast("long").alias(name)).filter(F.col(name) > 0)
    if flat:
        return rows.withColumn(SIGN, F.lit(1))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(element, name))).alias(name)).withColumn(SIGN, F.lit(1))


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", replicated: bool = False, limit_bytes: int = 64 << 20, insert_only: bool = False) -> DataFrame:
    """Equi-join; weights multiply.  how: inner, left, right, full, semi or anti.

    Unless both sides are insert_only, joins that tell whether a partner exists see net rows: sides are netted first.
    replicated asks for a broadcast of the right side, which happens only if its size is known to be at most
    limit_bytes; beyond that both sides are shuffled, and a skewed key is split at run time.
    """
    left, right = positive(left), positive(right)
    if how in ("semi", "anti"):
        held = right.select(*on) if insert_only else _netted(right.select(*on, SIGN)).select(*on)
        return left.join(held, list(on), f"left_{how}")
    if how != "inner" and not insert_only:
        left, right = _netted(left), _netted(right)
    other = right.withColumnRenamed(SIGN, "__other")
    if replicated and size_bound(right) <= limit_bytes:
        other = F.broadcast(other)
    out = left.join(other, list(on), how)
    return out.withColumn(SIGN, F.coalesce(SIGN, F.lit(1)) * F.coalesce("__other", F.lit(1))).drop("__other")


def _netted(df: DataFrame) -> DataFrame:
    """Net rows with their weights: an outer join must not see rows that were taken back."""
    return consolidate(df).filter(F.col(SIGN) > 0)


def size_bound(df: DataFrame) -> int:
    """Spark's upper estimate of a frame's bytes, from file sizes and plans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cogroup(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_bag: str = "left_rows", right_bag: str = "right_rows", insert_only: bool = False,
    windows: dict[int, int] | None = None, order: Sequence[str | Column] = (),
) -> DataFrame:
    """One row for each key of either side with both sides' net rows as arrays of structs, in a defined order.

    windows: by input index, the count window of one side: one row for each key and window_id then, each beside all of the other
    side's net rows.
    """
    windows, on = windows or {}, list(on)

    def bag(i: int, df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in columns(df) if c not in on]
        if i in windows:
            boxed = numbered(positive(df), on, order, "window_id").withColumn("window_id", F.floor(F.col("window_id") / windows[i]).cast("long"))
            return boxed.groupBy(*on, "window_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        return (positive(df) if insert_only else net_rows(positive(df))).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))

    both = bag(0, left, left_bag).join(bag(1, right, right_bag), on, "full")
    return both.select(*on, *(["window_id"] if windows else []), left_bag, right_bag, F.lit(1).alias(SIGN))


def union(*frames: DataFrame) -> DataFrame:
    """Bag union."""
    out = positive(frames[0])
    for df in frames[1:]:
        out = out.unionByName(positive(df))
    return out


def distinct(df: DataFrame) -> DataFrame:
    """Each net row once."""
    return _netted(positive(df)).withColumn(SIGN, F.lit(1))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """df with each key's rows numbered from 0 in the given order, in a new column.

    Rows are range-partitioned by key and order and sorted inside their ranges, so a key that holds most of the table is spread
    over many tasks.  A row's number is its place in its range plus the key's rows in the ranges before: a small
    table with a row for each key of a range.  The sorted rows are written once, so both are taken of the same ranges.
    """
    spark, ordered = df.sparkSession, [F.expr(o) if isinstance(o, str) else o for o in order]
    at, part, first, before = "at__", "range__", "first__", "before__"
    by = [*keys, *[f"order{i}__" for i in range(len(ordered))]]
    rows = df.withColumns({f"order{i}__": o for i, o in enumerate(ordered)}).repartitionByRange(*by).sortWithinPartitions(*by)
    folder = shared_folder(spark, "numbered")
    rows.drop(*by[len(keys) :]).withColumn(at, F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn(part, F.shiftright(at, 33))
    ranges = rows.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias("n__"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(before, F.coalesce(F.sum("n__").over(earlier), F.lit(0))).select(*[F.col(f"`{k}`").alias(f"key{i}__") for i, k in enumerate(keys)], F.col(part).alias("of__"), first, before)
    same = F.col(part) == F.col("of__")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"key{i}__"))
    return rows.join(ranges, same).select(*df.columns, (F.col(at) - F.col(first) + F.col(before)).alias(name))


def count_window(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: int, aggregates: Sequence[Aggregate]) -> DataFrame:
    """Tumbling windows of `size` rows for each key, in the given order; the last window may be open (partial).

    Insert-only input.  Numbering spreads the rows of a key; the windows then aggregate as groups.
    """
    boxed = numbered(positive(df), keys, order, "window_id").withColumn("window_id", F.floor(F.col("window_id") / size).cast("long"))
    return group(boxed, [*keys, "window_id"], aggregates, insert_only=True)
