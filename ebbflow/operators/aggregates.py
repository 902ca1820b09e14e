"""Aggregates with a batch form (Column expressions over signed rows) and a form for retractable streams.

Invertible aggregates keep sums that a retraction subtracts from.  All others keep the group's multiset of values and
are computed again from it; so any aggregate can be retracted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbflow.operators.ordering import order_text
from ebbflow.signed import SIGN


@dataclass(frozen=True)
class Aggregate:
    """name: result column; value: input column or None; kind: result type of the stream form.

    batch: expression over signed rows with columns `value` and SIGN.
    parts: sums that the stream form keeps (expressions over signed rows), or None if it keeps the multiset.
    finish: result from the sums, or from the Counter of values.
    from_values: the sums of a list of (value, weight), for groups that keep all values anyway (windows, mixed aggregates).
    extreme: the result is the smallest or (largest) the largest value, in Spark's order.
    columns: results from whole columns of sums, one for each key, or None if `finish` makes them key by key.
    """

    name: str
    value: str | None
    kind: str
    batch: Callable[[], Column]
    parts: dict[str, Callable[[], Column]] | None
    finish: Callable[[Any], Any]
    multiset: bool = False
    from_values: Callable[[list], dict] | None = None
    extreme: bool = False
    largest: bool = False
    columns: Callable[[dict[str, pa.Array]], pa.Array] | None = None


def _summed(known: list) -> dict:
    return {"n": sum(n for _, n in known), "s": sum(v * n for v, n in known if v is not None)}


def _known(n: pa.Array, results: pa.Array) -> pa.Array:
    """Results of the keys that have values; null for the others."""
    return pc.if_else(pc.greater(n, 0), results, pa.scalar(None, results.type))


def _present(value: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.col(SIGN)).otherwise(0)


def count(name: str = "count", value: str | None = None) -> Aggregate:
    """Rows, or rows with a value that is not null."""
    expr = (lambda: F.sum(F.col(SIGN)).cast("long")) if value is None else (lambda: F.sum(_present(value)).cast("long"))
    part = (lambda: F.col(SIGN).cast("long")) if value is None else (lambda: _present(value).cast("long"))
    return Aggregate(name, value, "long", expr, {"n": part}, lambda s: int(s["n"]), from_values=lambda known: {"n": sum(n for _, n in known)}, columns=lambda s: s["n"])


def total(value: str, name: str = "sum", kind: str = "double") -> Aggregate:
    """Sum of the values that are not null; null if there are none."""
    whole = lambda: F.coalesce(F.col(value) * F.col(SIGN), F.lit(0)).cast(kind)
    cast = int if kind in ("int", "long", "bigint") else float
    shown = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}.get(kind)
    return Aggregate(
        name, value, kind, lambda: F.when(F.sum(_present(value)) > 0, F.sum(F.col(value) * F.col(SIGN))).cast(kind),
        {"n": lambda: _present(value).cast("long"), "s": whole}, lambda s: cast(s["s"]) if s["n"] > 0 else None, from_values=_summed,
        columns=(lambda s: _known(s["n"], s["s"].cast(shown))) if shown else None,
    )


def average(value: str, name: str = "avg") -> Aggregate:
    """Mean of the values that are not null; null if there are none."""
    return Aggregate(
        name, value, "double", lambda: F.try_divide(F.sum(F.col(value) * F.col(SIGN)).cast("double"), F.sum(_present(value))),
        {"n": lambda: _present(value).cast("long"), "s": lambda: F.coalesce(F.col(value) * F.col(SIGN), F.lit(0)).cast("double")}, lambda s: float(s["s"]) / s["n"] if s["n"] > 0 else None, from_values=_summed,
        columns=lambda s: _known(s["n"], pc.divide(s["s"].cast(pa.float64()), s["n"].cast(pa.float64()))),
    )


def _extreme(pick: Callable, value: str, name: str, kind: str) -> Aggregate:
    batch = (lambda: F.min(value)) if pick is min else (lambda: F.max(value))
    return Aggregate(name, value, kind, batch, None, lambda c: pick((v for v, n in c.items() if n > 0 and v is not None), key=order_text, default=None), multiset=True, extreme=True, largest=pick is max)


def least(value: str, name: str = "min", kind: str = "long") -> Aggregate:
    """Smallest value of the net rows; a retraction of it brings back the runner-up."""
    return _extreme(min, value, name, kind)


def greatest(value: str, name: str = "max", kind: str = "long") -> Aggregate:
    """Largest value of the net rows."""
    return _extreme(max, value, name, kind)


#: Retractable extremes; all candidates are kept, so no number of them has to be chosen.
kmin, kmax = least, greatest


def recomputed(value: str, name: str, kind: str, batch: Callable[[], Column], function: Callable[[Counter], Any]) -> Aggregate:
    """Any aggregate: function computes it from the Counter of the group's values, batch over its net rows."""
    return Aggregate(name, value, kind, batch, None, function, multiset=True)


def invertible(
    value: str, name: str, kind: str, parts: dict[str, Callable[[Column], Column]], finish: Callable[[dict[str, Any]], Any], result: Callable[[dict[str, Column]], Column],
    from_values: Callable[[list], dict] | None = None,
) -> Aggregate:
    """A user's aggregate with an inverse: sums that an addition adds to and a retraction subtracts from.

    parts: what a value that is not null adds to each sum; finish: the result from the sums, in Python (streams);
    result: the same from the sums' Columns (batches); from_values: the sums of a list of (value, weight), which windows and
    groups with other aggregates need.  Both results are asked for only where the group has net rows.
    """
    signed = lambda make: F.when(F.col(value).isNotNull(), make(F.col(value)) * F.col(SIGN)).otherwise(F.lit(0))
    batch = lambda: result({p: F.sum(signed(make)) for p, make in parts.items()}).cast(kind)
    return Aggregate(name, value, kind, batch, {p: (lambda make=make: signed(make)) for p, make in parts.items()}, finish, from_values=from_values)
