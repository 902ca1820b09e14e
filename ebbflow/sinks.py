"""Sinks of signed frames: writers for batch frames, and foreachBatch functions for streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ebbflow.signed import SIGN, columns, expanded


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def signed_tab_text(df: DataFrame, path: str, mode: str = "append") -> None:
    """Tab-delimited lines with each row's weight in the last field; a null is an empty field."""
    df.select(F.concat_ws("\t", *[_text(c) for c in [*columns(df), SIGN]]).alias("value")).write.mode(mode).text(path)


def positives(df: DataFrame) -> DataFrame:
    """Additions alone, without the sign, each as often as its weight says."""
    return expanded(df.filter(F.col(SIGN) > 0)).drop(SIGN)


def tab_text(df: DataFrame, path: str, mode: str = "append") -> None:
    """Additions as tab-delimited lines."""
    rows = positives(df)
    rows.select(F.concat_ws("\t", *[_text(c) for c in rows.columns]).alias("value")).write.mode(mode).text(path)


def debug(rows: int = 20, verbose: bool = True) -> Callable[[DataFrame, int], None]:
    """Print the first rows of each micro-batch."""

    def show(batch: DataFrame, batch_id: int) -> None:
        if verbose:
            for row in batch.take(rows):
                print(f"DEBUG: {batch_id} {tuple(row)}")

    return show


def each_batch(write: Callable[[DataFrame, str], None], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes every micro-batch to its own folder: running one again changes nothing."""
    return lambda batch, batch_id: write(batch, f"{folder}/batch={batch_id}")


def upsert(folder: str, keys: Sequence[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Last addition of each key, as a versioned table in folder, dealt to buckets of keys: see `upserted`.

    A micro-batch reads and writes the buckets of its own keys alone, and a manifest that says which micro-batch wrote each
    bucket last.  A micro-batch that is run again starts from the manifest before it and replaces what it wrote itself.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in columns(batch) if c not in keys]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.filter(F.col(SIGN) > 0).drop(SIGN).withColumns({"__bucket": bucket, "__batch": F.lit(batch_id)})
        held = manifest(spark, folder, batch_id - 1) if batch_id else {}
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # as many as there are buckets at most
        if touched:
            if paths := _paths(folder, {b: held[b] for b in touched if b in held}):
                old = spark.read.schema(batch.drop(SIGN).schema).parquet(*paths).withColumns({"__bucket": bucket, "__batch": F.lit(-1)})
                new = new.unionByName(old)
            last = new.groupBy("__bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct("__batch", order)).alias("__row"))
            last.select("__bucket", *keys, "__row.*").repartition(min(len(touched), buckets), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{folder}/data/batch={batch_id}")
        rows = sorted((held | dict.fromkeys(touched, batch_id)).items())
        spark.createDataFrame(rows, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={batch_id}")

    return store


def manifest(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """Which micro-batch wrote each bucket last: a row for each bucket."""
    return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch long").parquet(f"{folder}/manifest/version={version}").collect()}


def _paths(folder: str, held: dict[int, int]) -> list[str]:
    return [f"{folder}/data/batch={i}/__bucket={b}" for b, i in sorted(held.items())]


def upserted(spark: SparkSession, folder: str, version: int, schema: StructType) -> DataFrame:
    """The table that `upsert` keeps, as it is after micro-batch `version`."""
    paths = _paths(folder, manifest(spark, folder, version))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
