"""Exact texts of keys and rows: what a state processor compares and keeps, without pandas touching any value.

A row is the JSON text of its fields by position.  Equal values have equal texts and every text leads back to its value:
timestamps keep their microseconds, integers all their digits, nulls are nulls, and -0.0 is 0.0 as in Spark's groups.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {
    "ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _stored(kind: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(kind, T.FloatType) else kind  # a float's shortest text is not exact as a double


def text_of(fields: T.StructType) -> Column:
    """The text of a row's fields."""
    cols = []
    for i, f in enumerate(fields.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
        cols.append(c.alias(f"f{i}"))
    return F.to_json(F.struct(*cols), OPTIONS) if cols else F.lit("{}")


def stored_type(fields: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f"f{i}", _stored(f.dataType)) for i, f in enumerate(fields.fields)])


def fields_of(text: Column, fields: T.StructType) -> list[Column]:
    """The fields of a row's text, under their names; all null for a null text."""
    row = F.from_json(text, stored_type(fields), OPTIONS)
    return [row[f"f{i}"].cast(f.dataType).alias(f.name) for i, f in enumerate(fields.fields)]


def rows_of(text: Column, fields: T.StructType) -> Column:
    """An array of structs, in a defined order, from a text that lists rows' texts; null for a null text."""
    rows = F.from_json(text, T.ArrayType(stored_type(fields)), OPTIONS)
    named = lambda r: F.struct(*[r[f"f{i}"].cast(f.dataType).alias(f.name) for i, f in enumerate(fields.fields)])
    return F.sort_array(F.transform(rows, named))


def _reader(kind: T.DataType) -> Callable[[Any], Any]:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat
    if isinstance(kind, T.DateType):
        return date.fromisoformat
    if isinstance(kind, T.BinaryType):
        return base64.b64decode
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float
    if isinstance(kind, T.DecimalType):
        return Decimal
    return lambda v: v


def values_of(text: str, kinds: Sequence[T.DataType]) -> tuple:
    """The Python values of a row's text."""
    row = json.loads(text, parse_float=Decimal)
    return tuple(None if (v := row[f"f{i}"]) is None else _reader(k)(v) for i, k in enumerate(kinds))


def readers(kinds: Sequence[T.DataType]) -> list[Callable[[Any], Any]]:
    """What makes the values of `written` ones again, type by type."""
    return [_reader(k) for k in kinds]


def written(v: Any) -> Any:
    """A value as JSON holds it."""
    if isinstance(v, datetime):
        return v.isoformat(timespec="microseconds")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(v).decode()
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, (list, tuple)):
        return [written(x) for x in v]
    if isinstance(v, dict):
        return {k: written(x) for k, x in v.items()}
    return v.item() if hasattr(v, "item") else v


def text_of_values(values: Sequence[Any]) -> str:
    """The text of a row of Python values."""
    return json.dumps({f"f{i}": written(v) for i, v in enumerate(values)}, ensure_ascii=False)


def compact_text(values: Sequence[Any]) -> str:
    """The text of a row of booleans, whole numbers and strings exactly as `text_of` writes it."""
    text = json.dumps({f"f{i}": v for i, v in enumerate(values)}, ensure_ascii=False, separators=(",", ":"))
    return re.sub(r"\\(?:u(....)|.)", lambda m: f"\\u{m[1].upper()}" if m[1] else m[0], text)
