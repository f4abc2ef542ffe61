"""Command line: python -m quern.cli directory|file|logs|render ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import __version__
from .settings import PREVIEW_ROWS, VALUES_SHOWN, VALUES_TRACKED


def _session(name: str, workers: int | None = None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    return (builder.master(f"local[{workers}]") if workers else builder).getOrCreate()


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quern")
    parser.add_argument("--version", action="version", version=f"quern {__version__}")
    what = parser.add_subparsers(dest="what", required=True)
    d = what.add_parser("directory", help="document the CSV files of a directory; the first rows only unless --full")
    d.add_argument("directory")
    d.add_argument("--output", default="quern_output")
    d.add_argument("--full", action="store_true")
    d.add_argument("--skip-existing", action="store_true", help="files whose outputs are all there are not read")
    d.add_argument("--no-croissant", action="store_true", help="write no draft metadata")
    d.add_argument("--checkpoint-dir", help="where a run saves what it has scanned; by default beside the output")
    d.add_argument("--checkpoint-every", type=int, default=100 << 30, metavar="BYTES", help="bytes of files to scan before saving")
    d.add_argument("--no-checkpoints", action="store_true")
    d.add_argument("--outstanding", action="store_true", help="only list what an ended run has left")
    d.add_argument("--workers", type=int, help="tasks at a time, where the session is local")
    f = what.add_parser("file", help="profile one CSV file, every row unless --preview")
    f.add_argument("path")
    f.add_argument("--json", nargs="?", const="-", metavar="FILE", help="a summary as JSON, to a file or the output")
    for p in (d, f):
        p.add_argument("--preview", type=int, nargs="?", const=PREVIEW_ROWS)
        p.add_argument("--separator", default=",")
        p.add_argument("--values-tracked", type=int, default=VALUES_TRACKED)
        p.add_argument("--values-shown", type=int, default=VALUES_SHOWN)
        p.add_argument("--batch-size", type=int, metavar="CELLS", help="cells that a task hands to Spark at once")
        p.add_argument("--no-identifier-check", action="store_true")
        p.add_argument("--quiet", action="store_true")
    logs = what.add_parser("logs", help="structure container logs")
    logs.add_argument("sources", nargs="+")
    logs.add_argument("--out", default=".")
    r = what.add_parser("render", help="Croissant metadata as Markdown")
    r.add_argument("metadata")
    r.add_argument("output", nargs="?")
    r.add_argument("-o", dest="also", metavar="OUTPUT")
    return parser


def main(arguments: list[str] | None = None) -> int:
    parser = _arguments()
    a = parser.parse_args(arguments)
    if a.what == "render":
        if a.output and a.also:
            parser.error("the output is named twice")
        return _render(a.metadata, a.output or a.also)
    if a.what == "logs":
        return _logs(a)
    if a.batch_size:
        os.environ["QUERN_CELLS_A_BATCH"] = str(a.batch_size)
    return _directory(a) if a.what == "directory" else _file(a)


def _told(a):
    return (lambda message: None) if a.quiet else lambda message: print(message, file=sys.stderr, flush=True)


def _directory(a) -> int:
    from .plans import directory

    spark = _session("quern", a.workers)
    state = None if a.no_checkpoints else a.checkpoint_dir or os.path.join(os.path.abspath(a.output), ".state")
    if a.outstanding:
        print(*(directory.State(spark, state, a.directory).outstanding() if state else []), sep="\n")
        return 0
    rows = None if a.full else a.preview or PREVIEW_ROWS
    text = directory.document(
        spark, a.directory, a.output, rows, a.separator, a.values_tracked, a.values_shown, not a.no_identifier_check, a.skip_existing,
        not a.no_croissant, state, a.checkpoint_every, _told(a),
    )
    print(text)
    return 0


def _file(a) -> int:
    from .operators import profile as P
    from .plans import directory, report
    from .sources.files import estimated_rows

    spark = _session("quern")
    expected = estimated_rows(a.path)
    _told(a)(f"{a.path}: " + (f"about {expected:,} rows" if expected is not None else "the number of rows is not known"))
    profiles, bad = directory.profiled(directory.scanned(spark, [a.path], a.separator, a.preview), a.values_tracked, a.values_shown)
    if problem := bad.collect():
        print(problem[0]["problem"], file=sys.stderr)
        return 1
    columns = [r.asDict(recursive=True) for r in profiles.orderBy("position").collect()]
    for c in columns:
        c["top"] = [(t["value"], t["n"]) for t in c["top"] or []]
    scope = f"preview of the first {a.preview:,} rows" if a.preview else "full scan"
    file = {"path": a.path, "size": os.path.getsize(a.path), "rows": max((c["rows_seen"] for c in columns), default=0), "columns": len(columns), "scope": scope}
    found = None if a.no_identifier_check else [r.asDict(recursive=True) for r in P.concerns(profiles, directory.KEYS).orderBy("column_name").collect()]
    if a.json:
        text = json.dumps({"file": file, "columns": columns, "columns_to_check": found}, ensure_ascii=False, indent=2)
        if a.json != "-":
            with open(a.json, "w", encoding="utf-8") as out:
                out.write(text + "\n")
        else:
            print(text)
        return 0
    print(report.file_report(file, columns, found, a.values_shown))
    return 0


def _render(source: str, target: str | None) -> int:
    from .plans import markdown

    try:
        with open(source, encoding="utf-8") as f:
            text = markdown.render(markdown.load(f.read()))
    except (OSError, ValueError) as bad:
        print(f"{source}: {bad}", file=sys.stderr)
        return 1
    if target:
        with open(target, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    return 0


def _logs(a) -> int:
    """All files are parsed in one job; each file's outputs are written by jobs that run side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from .operators import podlogs
    from .sources.scratch import new_folder

    spark = _session("quern logs")
    sources = podlogs.without_collisions(podlogs.find_sources(spark, a.sources)).collect()
    for r in podlogs.find_sources(spark, a.sources).where("not kept").collect():
        print(f"skipped {r['path']}: {r['reason']}")
    for r in sources:
        if not r["first"]:
            print(f"skipped {r['path']}: its output would replace another's")
    kept = {r["path"]: r["stem"] for r in sources if r["first"]}
    if not kept:
        return 1
    folder = new_folder(spark, "logs")
    podlogs.structure(podlogs.read_lines(spark, list(kept))).write.partitionBy("file").parquet(folder)
    rows = spark.read.schema(podlogs.ROW).parquet(folder)

    def write(path: str) -> None:
        podlogs.write(rows.where(F.col("file") == path), f"{a.out}/{kept[path]}.parsed.jsonl", f"{a.out}/{kept[path]}.parsed.csv")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, kept))
    by_file: dict[str, list] = {path: [] for path in kept}
    for r in podlogs.shown_tallies(podlogs.tallies(rows)).collect():
        by_file[r["file"]].append(r)
    for path, counted in by_file.items():
        if len(kept) == 1:
            print(path, *podlogs.summary(counted), sep="\n")
        else:
            print(podlogs.one_line(path, counted))
    if len(kept) > 1:
        print(f"all {len(kept)} files", *podlogs.summary(podlogs.shown_tallies(podlogs.tallies(rows, by_file=False), by_file=False).collect()), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
