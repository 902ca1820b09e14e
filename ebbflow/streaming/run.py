"""Running signed streams: replay of a table in micro-batches, idempotent results, net rows."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import StreamingQueryProgress
from pyspark.sql.types import BinaryType, StructType

from ebbflow.operators.relational import size_bound
from ebbflow.session import ROCKSDB, shared_folder
from ebbflow.signed import net_rows
from ebbflow.streaming.codec import compact_text, text_of, written
from ebbflow.streaming.processors import KEY

#: Tables of up to so many bytes are replayed as one file for each micro-batch, larger ones as a file for each core.
FILE_BYTES = 1 << 20
#: Rows of an Arrow batch in a stream's tasks, packed ones too.  A limit of its bytes would be looked at for each row, which costs
#: more than all else that is done with a row of numbers; the largest number is none.
ARROW_ROWS, ARROW_BYTES = 2000, (1 << 31) - 1


def replay(df: DataFrame, splits: int = 3, order: str | None = None) -> DataFrame:
    """A table as a stream of `splits` micro-batches, for tests and back-fills; with order, in ranges of that numeric column.

    Without an order the table is read once and dealt evenly over the files of all micro-batches.  Where the order has no more
    values than there are splits, each value is a micro-batch of its own; else the ranges are about equally large.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "replay")
    files = spark.sparkContext.defaultParallelism if size_bound(df) > FILE_BYTES else 1
    if order is None:
        df.repartition(splits * files).write.parquet(folder)
    else:
        few = sorted(r[0] for r in df.select(order).filter(F.col(order).isNotNull()).distinct().limit(splits + 1).collect())  # splits + 1 values at most
        bounds = few[:-1] if len(few) <= splits else df.approxQuantile(order, [i / splits for i in range(1, splits)], 0.001)
        tagged = df.withColumn("__split", sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0)))
        for i in range(len(bounds) + 1):  # one file set for each micro-batch; files are taken in the order they were written
            own = tagged.filter(F.col("__split") == i).drop("__split")
            (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(folder)
            for _ in range((i + 1) * files - len(spark.read.schema(df.schema).parquet(folder).inputFiles())):
                # parts without rows leave no file: the next range must not move up into this micro-batch
                spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@contextmanager
def _settings(spark: SparkSession, state_partitions: int | None) -> Iterator[None]:
    """The settings of signed streams; the session's own come back."""
    # state with a time to live would ask for batches without data for ever
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS)} | ({"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _writer(df: DataFrame, folder: str, name: str | None) -> DataStreamWriter:
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    writer = df.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.queryName(name) if name else writer


def run_available(df: DataFrame, folder: str | None = None, state_partitions: int | None = None, name: str | None = None) -> DataFrame:
    """Run a signed stream over all input there is and return its signed rows as a batch frame.

    Each micro-batch overwrites its own part, so a batch that is run again after a failure changes nothing.  A folder
    that is given again goes on from its checkpoint.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "stream")
    with _settings(spark, state_partitions):
        _writer(df, folder, name).trigger(availableNow=True).start().awaitTermination()
    return result_rows(spark, folder, df)


def run_for(df: DataFrame, seconds: float | None, done: Callable[[list[StreamingQueryProgress]], bool] | None = None, folder: str | None = None, state_partitions: int | None = None) -> tuple[DataFrame, list[StreamingQueryProgress]]:
    """Run a signed stream live for so many seconds at most (None: however long), or until `done` says so of the progress so far.

    Returns the signed rows of the micro-batches that have ended, and their progress (rows, durations, observed counts).
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "live")
    seen: dict[int, StreamingQueryProgress] = {}
    with _settings(spark, state_partitions):
        query = _writer(df, folder, None).trigger(processingTime="0 seconds").start()
        end = time.monotonic() + (float("inf") if seconds is None else seconds)
        while query.isActive and time.monotonic() < end:
            seen |= {p.batchId: p for p in query.recentProgress if p.numInputRows or p.batchId not in seen}
            if done and done(list(seen.values())):
                break
            query.awaitTermination(0.2)
        query.stop()
        if query.exception():
            raise query.exception()
    return result_rows(spark, folder, df), [seen[i] for i in sorted(seen)]


def timings(progress: Sequence[StreamingQueryProgress], observed: str | None = None) -> dict[str, float]:
    """Rows a second, and the median and 99th percentile of a micro-batch's milliseconds, of a live run.

    Rows are those that the sources gave, or, with the alias of an `observe`, the additions and retractions that came by there:
    a source that offers more than the stream wants gives more rows than those.
    """

    def rows(p: StreamingQueryProgress) -> int:
        if observed is None:
            return p.numInputRows
        seen = p.observedMetrics.get(observed)
        return sum(seen[c] or 0 for c in ("added", "taken_back")) if seen else 0

    busy = [(rows(p), p.batchDuration) for p in progress if rows(p)]
    took, came = sorted(ms for _, ms in busy), sum(n for n, _ in busy)
    at = lambda q: float(took[min(len(took) - 1, int(q * len(took)))]) if took else 0.0
    return {"rows": float(came), "rows_per_s": came / max(sum(took) / 1000, 1e-9), "p50_ms": at(0.5), "p99_ms": at(0.99)}


def result_rows(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All signed rows that a stream has stored in its folder."""
    return spark.read.schema(like.schema).parquet(f"{folder}/rows").select(*like.columns)


def net(df: DataFrame) -> DataFrame:
    """Net rows, each as often as it counts: a stream's result as a batch job would give it."""
    return net_rows(df)


def _column_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and sums of pages of columns, as the pages of single keys show them."""
    for batch in batches:
        for owner, page in zip(*(batch.column(c).to_pylist() for c in ("owner", "body")), strict=True):
            rows = pa.ipc.open_stream(page).read_all()
            names = rows.schema.names
            keys = [rows[n].to_pylist() for n in names if n == KEY or re.fullmatch("k[0-9]+__", n)]
            sums = [rows[n].to_pylist() for n in names if n == "__rows" or re.match("p[0-9]+_", n)]
            texts = rows[KEY].to_pylist() if KEY in names else [compact_text(k) for k in zip(*keys, strict=True)]
            values = [json.dumps(written(v), separators=(",", ":")) for v in zip(*sums, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([owner] * len(texts), pa.int64()), pa.array(texts, pa.string()), pa.array(values, pa.string())], names=["owner", "key", "values"])


def state_rows(spark: SparkSession, folder: str, variable: str = "sums", operator: int = 0) -> DataFrame:
    """What a stream that ran in `folder` holds in a state variable of its operator-th stateful operator.

    Variables in pages (owner, key, values: the values' JSON): sums (invertible aggregates; the owner is a bucket), rows
    (others), left and right (joins and cogroups), other (windowed cogroups).  All others as the state store gives them: last
    and sorted (extremes), place and rows or windows (count windows).
    """
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    state = reader.load(f"{folder}/checkpoint")
    if "user_map_key" not in state.columns or "page" not in state.schema["user_map_key"].dataType.names:
        return state
    body, page = F.col("user_map_value.body"), F.col("user_map_key.page")
    if isinstance(state.schema["user_map_value"].dataType["body"].dataType, BinaryType):
        return state.select(F.col("key.bucket__").alias("owner"), body.alias("body")).mapInArrow(_column_rows, "owner long, key string, values string")
    if "owner" not in state.schema["user_map_key"].dataType.names:
        owner, shared = F.col(f"key.{state.schema['key'].dataType.names[0]}"), F.lit(False)
    else:
        owner, shared = F.col("user_map_key.owner"), F.col("user_map_key.owner") == ""
    held = F.when(page == 0, F.get_json_object(body, "$.keys")).otherwise(body)
    entries = state.select(owner.alias("owner"), shared.alias("shared"), F.explode(F.from_json(held, "map<string,string>")).alias("key", "values"))
    own = entries.filter("not shared").select("owner", "key", "values")
    rows = F.from_json(F.get_json_object("values", "$[2]"), "map<string,string>")  # a small table's entry: [total, mark, rows]
    return own.unionByName(entries.filter("shared").select(F.col("key").alias("owner"), F.explode(rows).alias("key", "values")))


def state_of(spark: SparkSession, folder: str, values: dict[str, object], keys: str, variable: str = "sums", operator: int = 0) -> DataFrame:
    """What a stream holds for one key: `keys` is the key columns' schema, values their values."""
    one = spark.createDataFrame([tuple(values.values())], keys).select(text_of(StructType.fromDDL(keys)).alias("wanted"))  # one row
    held = state_rows(spark, folder, variable, operator)
    owned = F.col("key") if variable == "sums" else F.col("owner")
    return held.join(F.broadcast(one), owned == F.col("wanted"), "left_semi")
