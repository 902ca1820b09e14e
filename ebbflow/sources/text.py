"""Text sources, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.signed import SIGN, positive


def _lines(spark: SparkSession, path: str, stream: bool, max_files: int | None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def text_lines(spark: SparkSession, path: str, name: str = "text", stream: bool = False, max_files: int | None = None) -> DataFrame:
    """One additional row for each line."""
    return positive(_lines(spark, path, stream, max_files).withColumnRenamed("value", name))


def _typed(parts: Column, fields: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.get(parts, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]


def tab_text(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Tab-delimited lines as typed columns (name, type); a field that is absent or does not fit is null."""
    return _lines(spark, path, stream, max_files).select(*_typed(F.split("value", "\t"), fields), F.lit(1).alias(SIGN))


def signed_tab_text(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], stream: bool = False, max_files: int | None = None) -> DataFrame:
    """As tab_text, with each line's weight in its last field: reads what sinks.signed_tab_text wrote."""
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t")
    return _lines(spark, path, stream, max_files).select(*_typed(parts, fields), F.element_at(parts, -1).try_cast("int").alias(SIGN)).filter(F.col(SIGN).isNotNull())


def parquet(spark: SparkSession, path: str, stream: bool = False, schema: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files; a stream takes its schema from the files that are there unless one is given."""
    if not stream:
        return positive(spark.read.parquet(path))
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return positive(reader.parquet(path))


def rate(spark: SparkSession, rows: int, size: int, per_ms: int = 60_000, partitions: int | None = None) -> DataFrame:
    """A load stream: `rows` rows every per_ms with minute, number and a payload of `size` bytes (i mod 256)."""
    reader = spark.readStream.format("rate").option("rowsPerSecond", max(1, rows * 1000 // per_ms))
    if partitions:
        reader = reader.option("numPartitions", partitions)
    payload = bytearray(i % 256 for i in range(size))
    minute = F.date_trunc("minute", "timestamp").cast("string")
    return reader.load().select(minute.alias("last_minute"), F.col("value").cast("string").alias("cur_sent"), F.lit(payload).alias("buf"), F.lit(1).alias(SIGN))
