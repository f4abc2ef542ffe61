"""A running profile of a stream of rows: frequencies are the state, so no value is missed and restarts go on where they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import profile as P

KEYS = ("column_name", "position", "value")


def stream_frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, position, value, n) of a streaming table."""
    return P.frequencies(P.cells(P.as_text(rows, columns)))


def run(rows: DataFrame, columns: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Takes in all rows there are, then stops. Each micro-batch adds the frequencies that it has changed to the table in folder; a batch that is repeated replaces itself."""

    def add(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream_frequencies(rows, columns).writeStream.outputMode("update").foreachBatch(add)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """The latest frequencies in a folder that run() has written to."""
    return spark.read.option("basePath", folder).parquet(folder).groupBy(*KEYS).agg(F.max_by("n", "batch").alias("n"))
