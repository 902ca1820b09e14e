"""Text, JSON and time helpers."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens. (fixed value)
TOKEN_BREAKS = r'[ ",()*]+'
#: The key of a text that is no JSON, and what its value begins with. (fixed values)
ERROR_KEY, ERROR_TEXT = "error", "Could not parse: "


def tokenize(text: Column) -> Column:
    """Non-empty tokens between spaces, quotes, commas, parentheses and stars; null for null."""
    return F.filter(F.split(text, TOKEN_BREAKS), lambda w: w != "")


def lower(text: Column) -> Column:
    return F.lower(text)


def length(text: Column) -> Column:
    return F.length(text)


def strsplit(text: Column, pattern: str, limit: int, *names: str) -> Column:
    """A struct of the first parts of text, split at most limit - 1 times; absent parts are null."""
    parts = F.split(text, pattern, limit)
    return F.struct(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def try_text(c: Column, kind: str) -> Column:
    """Text to a type; what cannot be read is null."""
    return c.try_cast(kind)


def _step(name: str) -> str:
    if "'" in name and '"' in name:
        raise ValueError(f"a step of a path may not hold both kinds of quotes: {name}")
    return f'["{name}"]' if "'" in name else f"['{name}']"


def json_path(paths: str, text: Column) -> Column:
    """A map from each of the space-separated, /-nested paths to what it leads to in a JSON text, which is parsed once.

    A missing or blocked path gives '', a JSON null 'null', objects and arrays their JSON text; a text that cannot be
    parsed gives the one key `error`.
    """
    parsed = F.try_parse_json(text)
    entries = []
    for path in paths.split():
        leaf = F.try_variant_get(parsed, "$" + "".join(_step(s) for s in path.split("/")), "variant")
        entries += [F.lit(path), F.when(F.is_variant_null(leaf), "null").otherwise(F.coalesce(F.try_variant_get(leaf, "$", "string"), F.lit("")))]
    failed = F.create_map(F.lit(ERROR_KEY), F.concat(F.lit(ERROR_TEXT), text))  # null for a null text
    return F.when(parsed.isNull(), F.when(text.isNotNull(), failed)).otherwise(F.create_map(*entries))


def custom_format_to_iso(text: Column, pattern: str) -> Column:
    """Text in a custom time format as ISO text in UTC; null if it does not fit.  A leading weekday is skipped."""
    if pattern.startswith("EEE "):
        text, pattern = F.regexp_replace(text, r"^\S+ ", ""), pattern[4:]
    return F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_to_minute(iso: Column) -> Column:
    """ISO text cut to its minute, as ISO text; null if it does not fit."""
    return F.date_format(F.date_trunc("minute", F.try_to_timestamp(iso)), "yyyy-MM-dd'T'HH:mm'Z'")


def delay(mean_ms: float) -> Column:
    """Sleep for exponentially distributed times and return them: simulated cost, one Arrow batch at a time."""

    @F.pandas_udf("double")
    def wait(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        random = np.random.default_rng()
        for b in batches:
            ms = random.exponential(mean_ms, len(b)) if mean_ms > 0 else np.zeros(len(b))
            time.sleep(float(ms.sum()) / 1000)
            yield pd.Series(ms)

    return wait(F.lit(1))


def random_bag(mean: float, std: float, seed: int | None = None) -> Column:
    """An array of random non-negative integers; its size is a normal variate, rounded up, 0 at least.

    The size is drawn once: it stands in the expression once, as each place would draw its own.
    """
    n = F.ceil(F.greatest(F.lit(0.0), F.randn(seed) * std + mean)).cast("int")
    element = F.rand(None if seed is None else seed + 1)
    return F.transform(F.array_repeat(F.lit(0), n), lambda _: F.floor(element * F.lit(2147483647)).cast("int"))


def raise_when_equal(a: Column, b: Column) -> Column:
    """a; the query fails on a row where both are equal (for failure tests)."""
    return F.when(a == b, F.raise_error(F.lit("values are equal"))).otherwise(a)
