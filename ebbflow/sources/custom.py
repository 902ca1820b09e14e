"""Sources that users write themselves, as Spark's Python data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from ebbflow.signed import positive


def custom(spark: SparkSession, source: type[DataSource], stream: bool = False, **options: str) -> DataFrame:
    """What a user's source reads, as additions; a source whose rows have a sign column keeps it.

    A stream needs a source with a stream reader (or a simple one): it plans a micro-batch's offsets, reads its rows again if
    it is run again, and is told when they are committed.
    """
    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name())
    return positive(reader.options(**options).load())
