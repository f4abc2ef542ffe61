"""Tables that outlive a stage, and other small helpers around a session."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; the folder goes with the cluster's own clean-up
        return


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: batches are bounded by bytes rather than rows. A session that has set a smaller bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Partitions that a step asks for at most; with more data they grow, as sorts and hash joins spill.
MOST_PARTS = 20_000


def parts_for(volume: int, each: int = 32 << 20) -> int:
    """Partitions of about `each` (bytes or rows) of a volume, from 1 to MOST_PARTS."""
    return max(1, min(MOST_PARTS, -(-volume // each)))


class Workspace:
    """Written tables of one run of an operator, under the shared folder.

    A written table cuts the lineage: executors may be lost afterwards without anything being computed again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = new_folder(spark, name)
        small_batches(spark)
        atexit.register(_delete, spark, self.path)

    def write(self, name: str, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """Writes df and returns a reader of the written table."""
        df.write.mode("overwrite").option("compression", compression).parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads, and lets Spark delete shuffle files that nothing refers to any more."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add."""
    return df.drop(*names)


def map_texts(df: DataFrame, column: str, fields: list[tuple[str, str, object]], compute, most: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with new columns that compute() makes from blocks of a text column, in Arrow batches.

    fields: name, SQL type and Arrow type of each new column; a column of df with such a name is replaced. compute gets the
    text column of a block (about `most` bytes of whole texts) and returns the new columns in order. No shuffle.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from .text import blocks

    new = {name.lower() for name, _, _ in fields} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(sql)) for n, sql, _ in fields)])
    names = [f.name for f in kept]
    hidden = "quern_text"
    small_batches(df.sparkSession)
    passed = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{column}`").alias(hidden))

    def run(batches):
        for whole in batches:
            for part in blocks(whole, hidden, most):
                columns = compute(part.column(hidden))
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, _, kind) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=[*names, *(n for n, _, _ in fields)])
        pa.default_memory_pool().release_unused()  # workers live on

    return passed.mapInArrow(run, schema)
