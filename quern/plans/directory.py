"""A directory of CSV files: files are scanned in groups, then the driver writes texts from bounded rows.

A scan gives the counts of each file's values, and all that is told of a file follows from these: they are what a run
saves. Files are scanned in groups of about GROUP_BYTES; each group's counts are written to the run's state together with
its entries in the manifest. So a run that was ended goes on with the files that it had not scanned, if their earlier
counts are valid (see manifest.validity); a run that gets to its end discards its state.
"""

from __future__ import annotations

import json
import os
import time
import traceback
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..settings import DRAFTS, INDEX, MANIFEST_FORMAT, MARKDOWN, REPORTS, VALUES_SHOWN, VALUES_TRACKED
from ..sources import files as S
from ..sources import literal_csv as L
from ..sources.scratch import new_folder
from . import draft, manifest, markdown, report

KEYS = ("file", "position", "column_name")
#: Bytes of files that are scanned before the run's state is saved.
GROUP_BYTES = 100 << 30


def profiled(counts: DataFrame, cap: int = VALUES_TRACKED, shown: int = VALUES_SHOWN) -> tuple[DataFrame, DataFrame]:
    """Profiles with `top` and `coverage` of all columns of all good files, and rows (file, problem) of the others, from saved value_counts."""
    bad = counts.where(F.col("position") == L.PROBLEM).select("file", F.col("value").alias("problem"))
    good = counts.join(bad.select("file"), "file", "left_anti")
    headers = good.where("header").select("file", "position", F.col("value").alias("column_name"))
    freq = good.where("not header").select("file", "position", "value", "n", "row")
    at = ["file", "position"]
    top = P.top_values(freq, tuple(at), shown).groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    first = P.first_values(freq, "row", tuple(at))
    made = headers.join(P.profile(freq, tuple(at), cap), at, "left").join(top, at, "left").join(first, at, "left")
    made = made.fillna(0, [c for c in ("rows_seen", "empty_count", "null_like_text_count", "distinct_count", "number_count", "not_a_number_count", "top_count", "filled_in_count", "all_digit_count", "path_like_count")])
    made = made.fillna(False).withColumn("single_value_share", F.coalesce("single_value_share", F.lit(0.0)))
    covered = F.aggregate(F.coalesce("top", F.array()), F.lit(0).cast("long"), lambda a, t: a + t["n"])
    made = made.withColumn("coverage", F.when(F.col("filled_in_count") > 0, covered / F.col("filled_in_count")))
    return made, bad


def scanned(spark: SparkSession, paths: list[str], separator: str = ",", rows: int | None = None, folder: str | None = None) -> DataFrame:
    """The value_counts of files, scanned once and written to a folder (a scratch one if none is given)."""
    folder = folder or new_folder(spark, "counts")
    L.value_counts(L.read_files(spark, paths, separator, rows)).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


class State:
    """What a run has scanned so far: counts by group, and the manifest that says whose they are."""

    def __init__(self, spark: SparkSession, folder: str | None, directory: str):
        self.spark, self.kept = spark, folder is not None
        # another directory's state is not ours to read or to delete
        self.folder = f"{folder.rstrip('/')}/{uuid.uuid5(uuid.NAMESPACE_URL, directory).hex}" if folder else new_folder(spark, "state")
        self.saved, self.unreadable = None, False
        if self.kept:
            try:
                self.saved = manifest.read(spark, self.folder)
            except Exception:  # whatever is wrong with it, its figures cannot be used
                self.unreadable = True

    def usable(self, wanted: DataFrame) -> list:
        """wanted with their refusals, and the group that holds the counts of a file whose refusal is null."""
        return manifest.validity(wanted, self.saved, "off" if not self.kept else "the saved manifest is unreadable" if self.unreadable else None).collect()

    def scan(self, files: list[dict], separator: str, rows: int | None, fingerprint: dict) -> None:
        group = uuid.uuid4().hex
        scanned(self.spark, [f["path"] for f in files], separator, rows, f"{self.folder}/{group}")
        new = self.spark.createDataFrame([{**fingerprint, "path": f["path"], "size": f["size"], "modified": f["modified"], "rows_done": 1, "counts": group} for f in files], manifest.SCHEMA)
        paths = [f["path"] for f in files]
        self.saved = manifest.save(new if self.saved is None else self.saved.where(~F.col("path").isin(paths)).unionByName(new), self.folder)

    def counts(self, files: list[str]) -> DataFrame:
        """The counts of files, each from its own group."""
        own = self.saved.where(F.col("path").isin(files)).select(F.col("path").alias("file"), "counts")
        groups = [r["counts"] for r in own.select("counts").distinct().collect()]
        found = [self.spark.read.parquet(f"{self.folder}/{g}").withColumn("counts", F.lit(g)) for g in groups]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return every.join(own, ["file", "counts"], "left_semi").drop("counts")

    def outstanding(self) -> list[str]:
        """Files whose counts an earlier run has left."""
        return sorted(r["path"] for r in self.saved.select("path").collect()) if self.saved is not None else []

    def discard(self) -> None:
        manifest.clear(self.spark, self.folder)


def groups_of(files: list[dict], most: int) -> list[list[dict]]:
    """Files in order, in groups of about so many bytes, or of one file."""
    out: list[list[dict]] = []
    size = 0
    for f in files:
        if not out or size + f["size"] > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f["size"]
    return out


def rollup(profiles: DataFrame) -> DataFrame:
    """(file, rows, columns, empty_columns, constant_columns, columns_to_check): a row a file."""
    found = P.concerns(profiles, KEYS).where(P.needs_attention(F.col("verdict"))).select("file", "position", F.lit(True).alias("check"))
    marked = profiles.join(found, ["file", "position"], "left")
    names = lambda condition: F.transform(F.sort_array(F.collect_list(F.when(condition, F.struct("position", "column_name")))), lambda x: x["column_name"])
    return marked.groupBy("file").agg(
        F.max("rows_seen").alias("rows"), F.count("*").alias("columns"), names(F.col("is_all_empty")).alias("empty_columns"),
        names(F.col("holds_one_value") & ~F.col("is_all_empty")).alias("constant_columns"), names(F.coalesce("check", F.lit(False))).alias("columns_to_check"),
    )


def document(
    spark: SparkSession, directory: str, output: str, rows: int | None = None, separator: str = ",", cap: int = VALUES_TRACKED, shown: int = VALUES_SHOWN, identifiers: bool = True, skip_existing: bool = False,
    drafts: bool = True, state: str | None = None, save_every: int = GROUP_BYTES, told=lambda message: None,
) -> str:
    """Writes reports, drafts, their Markdown and the index of a directory into a local folder; returns the index. One bad file never stops a run. With a state folder an ended run is taken up; told gets a line for each step."""
    listed = [r.asDict() for r in S.classified(S.listing(spark, directory)).orderBy("name").collect()]
    files, others = [f for f in listed if f["is_csv"]], [f for f in listed if not f["is_csv"]]
    taken: set[str] = set()
    for f in files:
        f["scope"] = f"preview of the first {rows:,} rows" if rows else "full scan"
        paths = {k: os.path.join(output, k, f["stem"] + end) for k, end in ((REPORTS, ".txt"), (DRAFTS, ".draft.json"), (MARKDOWN, ".draft.md"))}
        f["paths"] = paths if drafts else {REPORTS: paths[REPORTS]}
        f["status"] = "failed" if f["stem"] in taken else "skipped" if skip_existing and all(map(os.path.exists, f["paths"].values())) else "read"
        f["problem"] = "another file of this directory has the same outputs" if f["stem"] in taken else None
        taken.add(f["stem"])
    for folder in (REPORTS, DRAFTS, MARKDOWN) if drafts else (REPORTS,):
        os.makedirs(os.path.join(output, folder), exist_ok=True)
    wanted = [f for f in files if f["status"] == "read"]
    columns: dict[str, list[dict]] = {}
    problems: dict[str, str] = {}
    found: dict[str, list[dict]] = {}
    began = time.time()
    told(f"{directory}: {len(files)} CSV files of {sum(f['size'] for f in files):,} bytes, {len(files) - len(wanted)} of them not to be read, {len(others)} other files")
    run = State(spark, state, directory)
    if wanted:
        fingerprint = {"format": MANIFEST_FORMAT, "separator": separator, "cap": cap, "preview": rows or 0, "identifiers": identifiers}
        asked = spark.createDataFrame([{**fingerprint, "path": f["path"], "size": f["size"], "modified": f["modified"]} for f in wanted], manifest.WANTED)
        refused = {r["path"]: r["refusal"] for r in run.usable(asked)}
        fresh = [f for f in wanted if refused[f["path"]]]
        if len(fresh) < len(wanted):
            told(f"{len(wanted) - len(fresh)} files were scanned by an earlier run")
        done = 0
        for group in groups_of(fresh, save_every):
            run.scan(group, separator, rows, fingerprint)
            done += len(group)
            told(f"scanned {done} of {len(fresh)} files, {time.time() - began:.0f} s")
        profiles, bad = profiled(run.counts([f["path"] for f in wanted]), cap, shown)
        profiles = profiles.persist()
        for r in profiles.orderBy("file", "position").collect():  # columns x values shown
            d = r.asDict(recursive=True)
            d["top"] = [(t["value"], t["n"]) for t in d["top"] or []]
            d["most_common_values"] = [{"value": v, "count": n} for v, n in d["top"]]
            columns.setdefault(d["file"], []).append(d)
        if identifiers:
            for r in P.concerns(profiles, KEYS).join(profiles.select(*KEYS, "example"), list(KEYS)).orderBy("file", "column_name").collect():
                found.setdefault(r["file"], []).append(r.asDict(recursive=True))
        problems = {r["file"]: r["problem"] for r in bad.collect()}
        profiles.unpersist()
    outcomes = []
    for f in files:
        outcomes.append(_written(f, columns.get(f["path"]), problems.get(f["path"]), found.get(f["path"], []) if identifiers else None, shown, round(time.time() - began, 2)))
    text = report.index(directory, outcomes, others, f"preview of the first {rows:,} rows" if rows else "every row")
    with open(os.path.join(output, INDEX), "w", encoding="utf-8") as out:
        out.write(text)
    run.discard()
    states = [o["status"] for o in outcomes]
    told(", ".join(f"{states.count(s)} {s}" for s in ("read", "skipped", "failed")) + f"; {time.time() - began:.0f} s")
    return text


def _written(f: dict, columns: list[dict] | None, problem: str | None, concerns: list[dict] | None, shown: int, seconds: float) -> dict:
    """Writes a file's outputs and returns its outcome; whatever fails here becomes part of the outcome."""
    def put(folder: str, text: str) -> None:
        with open(f["paths"][folder], "w", encoding="utf-8") as out:
            out.write(text)

    base = {k: f[k] for k in ("name", "size", "stem", "status", "scope")}
    if f["status"] == "skipped":
        try:
            with open(f["paths"][DRAFTS], encoding="utf-8") as earlier:
                known = draft.outcome_of(json.load(earlier))
        except (OSError, ValueError, KeyError, TypeError):
            known = draft.outcome_of({})
        return base | known | {"drafted": DRAFTS in f["paths"]}
    if f["problem"]:
        return base | {"problem": f["problem"]}
    try:
        if problem or columns is None:
            raise ValueError(problem or "nothing was read")
        file = {"path": f["path"], "name": f["name"], "stem": f["stem"], "size": f["size"], "rows": max(c["rows_seen"] for c in columns), "scope": f["scope"], "seconds": seconds}
        put(REPORTS, report.file_report(file, columns, concerns, shown))
    except Exception as bad:
        put(REPORTS, f"COULD NOT READ {f['path']}\n\n{bad}\n\n{'' if problem else traceback.format_exc()}")
        return base | {"status": "failed", "problem": str(bad)}
    out = base | {
        "rows": file["rows"], "columns": len(columns), "empty_columns": [c["column_name"] for c in columns if c["is_all_empty"]],
        "constant_columns": [c["column_name"] for c in columns if c["holds_one_value"] and not c["is_all_empty"]],
        "columns_to_check": [c["column_name"] for c in concerns or [] if "path" in c["verdict"] or "NOT consistent" in c["verdict"]],
    }
    if DRAFTS not in f["paths"]:
        return out
    try:
        made = draft.build(file, columns, [{k: v for k, v in c.items() if k not in ("file", "position")} for c in concerns] if concerns is not None else None)
        put(DRAFTS, json.dumps(made, indent=2, ensure_ascii=False))
        put(MARKDOWN, markdown.render(made))
        return out | {"drafted": True}
    except Exception as bad:
        return out | {"draft_problem": str(bad)}
