"""Texts that order as Spark orders the values: what keeps a multiset sorted in state.

NaN is the largest number, -0.0 is 0.0, decimals of one type order by their digits, strings by code points (which is
the order of their UTF-8 bytes), timestamps and dates by time, false before true.
"""

from __future__ import annotations

import struct
from datetime import date, datetime
from decimal import Decimal
from typing import Any

#: Longs and decimals of 38 digits become positive by these offsets.
LONG, WIDE = 1 << 63, 10**38


def order_text(v: Any) -> str:
    """A text whose code-point order is the order of the values of one type."""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, int):
        return f"{v + LONG:020d}"
    if isinstance(v, float):
        if v != v:
            return "f" * 17
        bits = struct.unpack(">Q", struct.pack(">d", v + 0.0))[0]  # -0.0 + 0.0 is 0.0
        return f"{bits ^ (1 << 63) if bits < 1 << 63 else (1 << 64) - 1 - bits:017x}"
    if isinstance(v, Decimal):
        whole, _, rest = f"{v:f}".lstrip("-").partition(".")
        digits = int(whole + (rest + "0" * 38)[:38])
        return f"{WIDE * WIDE + (-digits if v < 0 else digits):077d}"
    if isinstance(v, datetime):
        return v.isoformat(timespec="microseconds")
    if isinstance(v, date):
        return f"{v.toordinal():08d}"
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):  # nulls first, then element by element
        return "".join("0" if x is None else "1" + order_text(x).replace("\0", "\0\1") + "\0\0" for x in v)
    raise TypeError(f"values of type {type(v).__name__} have no order in state")
