"""Sources without a table behind them, and the sinks that print or write each micro-batch."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from ebbflow import sinks
from ebbflow.operators.aggregates import count
from ebbflow.plans import Relation
from ebbflow.session import shared_folder
from ebbflow.signed import SIGN
from ebbflow.sources import text as sources
from ebbflow.sources.custom import custom
from ebbflow.streaming.run import replay


def countdown() -> type[DataSource]:
    """Made in a function, so that workers get the class itself and need not import this module."""

    class Countdown(DataSource):
        """The numbers from n down to 1, and each even one taken back."""

        @classmethod
        def name(cls):
            return "countdown"

        def schema(self):
            return f"k int, {SIGN} int"

        def _rows(self):
            n = int(self.options["n"])
            return [(i, 1) for i in range(n, 0, -1)] + [(i, -1) for i in range(n, 0, -1) if i % 2 == 0]

        def reader(self, schema):
            rows = self._rows()

            class All(DataSourceReader):
                def read(self, partition):
                    yield from rows

            return All()

        def simpleStreamReader(self, schema):
            rows = self._rows()

            class Steps(SimpleDataSourceStreamReader):
                def initialOffset(self):
                    return {"at": 0}

                def read(self, start):
                    end = min(start["at"] + 4, len(rows))
                    return iter(rows[start["at"] : end]), {"at": end}

                def readBetweenOffsets(self, start, end):
                    return iter(rows[start["at"] : end["at"]])

                def commit(self, end):
                    pass

            return Steps()

    return Countdown


def wait(stream, done, seconds: int = 60) -> None:
    """Until done() holds, the stream ends, or time is up."""
    end = time.monotonic() + seconds
    while not done() and stream.isActive and time.monotonic() < end:
        time.sleep(0.2)


def test_a_users_source(spark):
    query = lambda df: Relation.load(df, "c").group("g", ["k"], count("n")).rows()
    expected = {(1, 1): 1, (3, 1): 1, (5, 1): 1}
    assert Counter(tuple(r) for r in query(custom(spark, countdown(), n="5")).collect()) == expected
    live, seen = custom(spark, countdown(), stream=True, n="5"), []
    writer = live.writeStream.foreachBatch(lambda b, i: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", shared_folder(spark, "countdown"))
    stream = writer.trigger(processingTime="100 milliseconds").start()
    try:
        wait(stream, lambda: len(seen) >= 7)
    finally:
        stream.stop()
    assert Counter(seen) == {**{(i, 1): 1 for i in range(1, 6)}, (2, -1): 1, (4, -1): 1}


def test_rate_load(spark):
    df = sources.rate(spark, rows=6000, size=300, per_ms=1000, partitions=2)
    seen = []
    writer = df.writeStream.foreachBatch(lambda b, i: seen.extend(b.select("last_minute", F.col("cur_sent").cast("long").alias("n"), "buf", SIGN).limit(5).collect()))
    stream = writer.option("checkpointLocation", shared_folder(spark, "rate")).trigger(processingTime="200 milliseconds").start()
    try:
        wait(stream, lambda: seen)
    finally:
        stream.stop()
    assert all(bytes(r["buf"]) == bytes(i % 256 for i in range(300)) and r[SIGN] == 1 and r["last_minute"].endswith(":00") for r in seen)
    assert len({r["n"] for r in seen}) == len(seen)


def test_max_files_caps_a_batch(spark):
    folder = shared_folder(spark, "lines")
    for i in range(3):
        spark.createDataFrame([(f"line {i}",)], "value string").coalesce(1).write.mode("append").text(folder)
    sizes = []
    live = sources.text_lines(spark, folder, "line", stream=True, max_files=2)
    live.writeStream.foreachBatch(lambda b, i: sizes.append(b.count())).option("checkpointLocation", shared_folder(spark, "cap")).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 3 and max(sizes) == 2


def test_debug_and_each_batch_sinks(spark, capsys):
    live = replay(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, x string"), 1)
    folder = shared_folder(spark, "stored")
    write = sinks.each_batch(lambda b, path: sinks.tab_text(b, path, "overwrite"), folder)
    signed = Relation.load(live, "s").df

    def both(batch, i):
        sinks.debug(rows=2)(batch, i)
        sinks.debug(verbose=False)(batch, i)
        write(batch, i)
        write(batch, i)  # again, as after a failure

    signed.writeStream.foreachBatch(both).option("checkpointLocation", shared_folder(spark, "both")).trigger(availableNow=True).start().awaitTermination()
    assert capsys.readouterr().out.count("DEBUG: 0 (") == 2
    assert Counter(r["value"] for r in spark.read.text(folder).select("value").collect()) == {"1\ta": 1, "2\tb": 2}
