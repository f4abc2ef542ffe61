"""A data source that reads delimited text literally: every cell as written, blank lines as rows, bad files as rows with a problem.

Spark's own reader drops blank lines, forgives rows of the wrong width and unterminated quotes, and does not know xz. Here
each file is one partition of rows (file, row, cells, problem); row 0 is the header. A file that cannot be read gives one row
with its problem, so that it never fails the job that reads its neighbours. Rows go to Spark in Arrow batches of about
CELLS_A_BATCH cells. Whether a line break is inside quotes can only be told from the file's beginning on, so files are what
is read side by side: a directory of many files scales with them, a single file does not.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import rows_a_batch
from .lines import open_bytes

SCHEMA = "file string, row long, cells array<string>, problem string"
_ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("problem", pa.string())])


def open_text(path: str) -> io.TextIOBase:
    """A local file, plain or compressed, as strict UTF-8 without a leading mark."""
    return io.TextIOWrapper(open_bytes(path), encoding="utf-8-sig", errors="strict", newline="")


def header_names(cells: list[str]) -> list[str]:
    """Names as written; a blank one is named by its place, a repeated one by its turn."""
    seen: dict[str, int] = {}
    taken, out = set(cells), []
    for k, cell in enumerate(cells):
        name = cell or f"Unnamed: {k}"
        base = name
        while name in seen or (name != base and name in taken):
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}.{seen[base]}"
        seen.setdefault(name, 0)
        out.append(name)
    return out


class _Lines:
    """Lines of a text; whether they have ended, and whether the last one held a zero character."""

    def __init__(self, lines: Iterator[str]):
        self.lines, self.ended, self.zero = lines, False, False

    def __iter__(self):
        for line in self.lines:
            if "\x00" in line:
                self.zero = True
            yield line
        self.ended = True


def rows_of(lines: Iterator[str], separator: str = ",", most: int | None = None) -> Iterator[list[str]]:
    """Header names, then rows of as many cells; a cell ends at a zero character. Raises ValueError with what is wrong with the text."""
    watched = _Lines(lines)
    width = n = 0
    try:
        for row in csv.reader(iter(watched), delimiter=separator):
            if watched.ended:  # the reader asked for more to end this row
                raise ValueError(f"a quote that opens in row {n} is never closed")
            if watched.zero:
                row, watched.zero = [cell.split("\x00", 1)[0] for cell in row], False
            if not width:
                if row:
                    width = len(row)
                    yield header_names(row)
                continue
            if len(row) != width:
                if len(row) > width:
                    raise ValueError(f"row {n + 1} has {len(row)} cells, the header has {width}")
                row += [""] * (width - len(row))
            n += 1
            if most is not None and n > most:
                return
            yield row
    except csv.Error as problem:
        raise ValueError(str(problem)) from problem
    if not width:
        raise ValueError("no columns to read: the file is empty")


def _batch(path: str, first: int, rows: list[list[str]], width: int) -> pa.RecordBatch:
    n = len(rows)
    cells = pa.ListArray.from_arrays(pa.array(range(0, n * width + 1, width), pa.int32()), pa.array(chain.from_iterable(rows), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), cells, pa.nulls(n, pa.string())], schema=_ARROW)


def batches_of(path: str, separator: str, most: int | None) -> Iterator[pa.RecordBatch]:
    """A file's rows; whatever is wrong with it is the problem of a last row."""
    csv.field_size_limit(sys.maxsize)
    held: list[list[str]] = []
    done, width, room = 0, 0, 1
    try:
        with open_text(path) as f:
            for row in rows_of(iter(f), separator, most):
                if not width:
                    width, room = len(row), rows_a_batch(len(row))
                held.append(row)
                if len(held) == room:
                    yield _batch(path, done, held, width)
                    done, held = done + len(held), []
        if held:
            yield _batch(path, done, held, width)
    except Exception as problem:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.string())), pa.array([f"{type(problem).__name__}: {problem}"])], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.separator = options.get("sep", ",")
        self.most = int(options["maxrows"]) if options.get("maxrows") else None

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        yield from batches_of(partition.value, self.separator, self.most)


class LiteralCsv(DataSource):
    @classmethod
    def name(cls):
        return "literal_csv"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_files(spark: SparkSession, paths: list[str], separator: str = ",", rows: int | None = None) -> DataFrame:
    """Rows (file, row, cells, problem) of all files; with rows at most so many of each, which ends the reading early."""
    if rows is not None and rows < 1:
        raise ValueError("a preview needs at least one row")
    spark.dataSource.register(LiteralCsv)
    reader = spark.read.format("literal_csv").option("paths", "\n".join(paths)).option("sep", separator)
    return (reader.option("maxrows", str(rows)) if rows else reader).load()


def read_csv(spark: SparkSession, path: str, separator: str = ",", rows: int | None = None) -> DataFrame:
    """One file as a table of text columns; raises ValueError if the file is bad."""
    raw = read_files(spark, [path], separator, rows)
    head = raw.where("row = 0 or problem is not null").collect()
    bad = [r["problem"] for r in head if r["problem"]]
    if bad:
        raise ValueError(bad[0])
    return raw.where("row > 0").select(*[F.col("cells")[k].alias(c) for k, c in enumerate(head[0]["cells"])])


#: Places of what is no cell of a row: a header's cells keep theirs.
PROBLEM = -1


def value_counts(raw: DataFrame) -> DataFrame:
    """(file, header, position, value, n, row): how often each value is in each column of the files, and its first row; headers' cells, and problems at position PROBLEM. One scan, one exchange."""
    cells = F.when(F.col("problem").isNull(), F.col("cells")).otherwise(F.array("problem"))
    placed = raw.select("file", "row", F.coalesce(F.col("row") == 0, F.lit(False)).alias("header"), F.col("problem").isNotNull().alias("bad"), F.posexplode(cells).alias("position", "value"))
    at = F.when(F.col("bad"), F.lit(PROBLEM)).otherwise(F.col("position")).alias("position")
    return placed.groupBy("file", "header", at, "value").agg(F.count("*").alias("n"), F.min("row").alias("row"))
