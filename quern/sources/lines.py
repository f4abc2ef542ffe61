"""Numbered lines of text files: blank lines count, bytes that are no UTF-8 become U+FFFD."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, line long, text string"
_ARROW = pa.schema([("file", pa.string()), ("line", pa.int64()), ("text", pa.string())])
#: Bytes of lines that go to Spark at once.
BATCH_BYTES = 4 << 20


def open_bytes(path: str):
    """A local or mounted file, plain or compressed."""
    import bz2
    import gzip
    import lzma

    opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(path.rsplit(".", 1)[-1].lower(), open)
    return opener(path.removeprefix("file://").removeprefix("file:"), "rb")


def _batch(path: str, first: int, lines: list[str], numbers: list[int] | None = None) -> pa.RecordBatch:
    at = numbers or range(first, first + len(lines))
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(at, pa.int64()), pa.array(lines, pa.string())], schema=_ARROW)


def lines_of(path: str) -> Iterator[pa.RecordBatch]:
    n = 0
    with open_bytes(path) as f:
        while some := f.readlines(BATCH_BYTES):
            yield _batch(path, n + 1, [raw.rstrip(b"\r\n").decode("utf-8", "replace") for raw in some])
            n += len(some)


def first_of(path: str) -> Iterator[pa.RecordBatch]:
    """The first line that is not blank; null if there is none or the file cannot be read."""
    try:
        with open_bytes(path) as f:
            found = next(((n, text) for n, raw in enumerate(f, 1) if (text := raw.decode("utf-8", "replace").strip())), (None, None))
    except (OSError, EOFError):
        found = (None, None)
    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found[0]], pa.int64()), pa.array([found[1]], pa.string())], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.read_one = first_of if options.get("first") == "true" else lines_of

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        yield from self.read_one(partition.value)


class NumberedLines(DataSource):
    @classmethod
    def name(cls):
        return "numbered_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _read(spark: SparkSession, paths: list[str]):
    spark.dataSource.register(NumberedLines)
    return spark.read.format("numbered_lines").option("paths", "\n".join(paths))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, text), one partition a file."""
    return _read(spark, paths).load()


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, text) of each file's first line that is not blank, null without one."""
    return _read(spark, paths).option("first", "true").load()
