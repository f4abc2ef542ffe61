"""What earlier runs have done: which files need no reading, and whether saved figures still hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import MANIFEST_FORMAT

KINDS = ("report", "draft", "markdown")
#: What a file's figures depend on; a setting that only changes speed is not among them.
FINGERPRINT = ("format", "path", "size", "modified", "separator", "cap", "preview", "identifiers")


def complete_outputs(outputs: DataFrame) -> DataFrame:
    """(stem) of files with all kinds of output, from rows (stem, kind)."""
    return outputs.where(F.col("kind").isin(*KINDS)).groupBy("stem").agg(F.countDistinct("kind").alias("kinds")).where(F.col("kinds") == len(KINDS)).select("stem")


def to_read(files: DataFrame, outputs: DataFrame) -> DataFrame:
    return files.join(complete_outputs(outputs), "stem", "left_anti")


def to_skip(files: DataFrame, outputs: DataFrame) -> DataFrame:
    return files.join(complete_outputs(outputs), "stem", "left_semi")


def in_order(fresh: DataFrame, reused: DataFrame, files: DataFrame) -> DataFrame:
    """Outcomes of both kinds in the listing's order."""
    return files.select("stem", F.col("name").alias("ord")).join(fresh.unionByName(reused, allowMissingColumns=True), "stem").orderBy("ord").drop("ord")


SCHEMA = "format int, path string, size long, modified long, separator string, cap int, preview int, identifiers boolean, rows_done long, counts string"
WANTED = SCHEMA.removesuffix(", rows_done long, counts string")


def _same(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"w.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names])


def validity(wanted: DataFrame, saved: DataFrame | None, not_at_all: str | None = None) -> DataFrame:
    """wanted files with `refusal`: why their saved figures cannot be used, null if they can. Both have FINGERPRINT; saved also rows_done. not_at_all is a reason that holds for all files; without saved figures there are none."""
    if not_at_all or saved is None:
        return wanted.withColumn("refusal", F.lit(not_at_all or "nothing saved"))
    both = wanted.alias("w").join(saved.alias("s"), F.col("w.path") == F.col("s.path"), "left")
    why = (
        F.when(F.col("s.path").isNull(), "nothing saved")
        .when(F.col("s.format") != MANIFEST_FORMAT, "saved by another version")
        .when(F.col("w.size").isNull(), "the file is gone")
        .when(~_same(("size", "modified")), "the file has changed")
        .when(~_same(("separator", "cap", "preview", "identifiers")), "the settings have changed")
        .when(F.coalesce(F.col("s.rows_done"), F.lit(0)) <= 0, "no progress saved")
    )
    return both.select("w.*", why.alias("refusal"))


def state_counts(outcomes: DataFrame) -> DataFrame:
    """(status, n): how many files are in which state."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Whole versions of the manifest in a folder, the latest last."""
    path, system = _hadoop(spark, folder)
    if not system.exists(path(folder)):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in system.listStatus(path(folder)) if s.isDirectory()]
    return sorted(int(name.removeprefix("manifest-")) for name, p in found if name.startswith("manifest-") and system.exists(path(p, "_SUCCESS")))


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest whole manifest of a folder; None if there is none."""
    known = versions(spark, folder)
    return spark.read.parquet(f"{folder}/manifest-{known[-1]}") if known else None


def save(manifest: DataFrame, folder: str) -> DataFrame:
    """Writes the manifest's next version and returns it. Until it is whole the one before counts; older ones than that go."""
    spark = manifest.sparkSession
    known = versions(spark, folder)
    number = known[-1] + 1 if known else 1
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest-{number}")
    path, system = _hadoop(spark, folder)
    for old in known[:-1]:
        system.delete(path(f"{folder}/manifest-{old}"), True)
    return read(spark, folder)


def clear(spark: SparkSession, folder: str) -> None:
    """Deletes a run's own state folder; others beside it stay."""
    path, system = _hadoop(spark, folder)
    system.delete(path(folder), True)
