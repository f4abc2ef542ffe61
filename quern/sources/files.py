"""Listings of files, through Spark's file systems."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import CELLS_A_BATCH, EXACT_COUNT_BYTES, LEAST_BATCH, MOST_BATCH

LISTING = "path string, name string, size long, modified long"


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """Files directly in a directory: path, name, size, modified (ms); subdirectories are not entered."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(directory)
    found = where.getFileSystem(conf).listStatus(where)
    rows = [(f.getPath().toString(), f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found if f.isFile()]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), LISTING)


def classified(files: DataFrame) -> DataFrame:
    """A listing with is_csv, stem, compression and, for files not read, the reason."""
    name = F.col("name")
    suffix = T.csv_suffix(name)
    why = F.when(suffix != "", None).when(F.lower(name).endswith(".zip"), "an archive may hold several files").otherwise("not a CSV file")
    return files.withColumns({"is_csv": suffix != "", "stem": T.dataset_stem(name), "compression": T.compression(name), "reason": why})


def collisions(files: DataFrame) -> DataFrame:
    """CSV files whose outputs would overwrite another's: all but the first by name of each stem."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("stem").orderBy("name"))
    return files.where("is_csv").withColumn("n", rank).where("n > 1").drop("n")


def rows_a_batch(columns: int) -> int:
    """Rows of so many columns that make a batch of CELLS_A_BATCH cells, within bounds."""
    cells = int(os.environ.get("QUERN_CELLS_A_BATCH", CELLS_A_BATCH))
    return max(LEAST_BATCH, min(MOST_BATCH, cells // max(columns, 1)))


def _line_ends(f, most: int | None) -> int:
    """Line ends in the next `most` bytes, or in all that follow."""
    lines = read = 0
    while (most is None or read < most) and (block := f.read(1 << 20 if most is None else min(1 << 20, most - read))):
        lines, read = lines + block.count(b"\n"), read + len(block)
    return lines


def estimated_rows(path: str, points: int = 8, sample: int = 1 << 16, exact: int | None = EXACT_COUNT_BYTES) -> int | None:
    """Rows of a local file, for a progress line unless exact is None; None if it cannot be read.

    A text of up to `exact` bytes (None: of any size), compressed or not, is counted. Longer ones are estimated: from
    samples, or from the first `exact` bytes of a compressed one.
    """
    import bz2
    import gzip
    import lzma
    import zlib

    opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(path.rsplit(".", 1)[-1].lower())
    try:
        size = os.path.getsize(path)
        if opener:
            with open(path, "rb") as raw, opener(raw) as f:
                lines = _line_ends(f, exact)
                used = max(1, min(size, raw.tell()))
                whole = f.read(1) == b""
            return max(0, round(lines * (1 if whole else size / used)) - 1)
        with open(path, "rb") as f:
            if exact is None or size <= exact:
                return max(0, _line_ends(f, None) - 1)
            lines = read = 0
            for k in range(points):
                f.seek((size - sample) * k // max(1, points - 1))
                block = f.read(sample)
                lines, read = lines + block.count(b"\n"), read + len(block)
            return max(0, round(lines * size / read) - 1)
    except (OSError, EOFError, lzma.LZMAError, zlib.error):
        return None


def write_csv(df: DataFrame, path: str, separator: str = ",") -> str:
    """One local file with a header, written row by row; returns its path. Nulls are empty."""
    import csv

    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, delimiter=separator, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows(df.toLocalIterator())
    return path
