"""Container logs, a JSON record a line, to one wide table.

Lines are records of a collector; the application's own line is their field `log`. Long lines arrive in fragments and are
put together again in order of line within their file, source, container and stream. Fields keep the text they were written
as, numbers too, and the order they came in, so records are maps until a sink asks for columns.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import logline

UNFINISHED = "partial-unfinished: a fragment with no final record after it; kept as found"
OUTPUTS = (".parsed.jsonl", ".parsed.csv")

ROW = "file string, line long, place long, late boolean, partials int, fields map<string,string>, shape string, problems array<string>"
PIECE = "file string, line long, text string, fields map<string,string>, log string, part string, source string"
_ROW = ("file", "line", "place", "late", "partials", "fields", "shape", "problems")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, text) of non-blank lines, without line numbers copied from a terminal. Files are read whole by one task each, as lines are counted."""
    from ..sources.lines import read_lines as numbered

    rows = numbered(spark, paths).where(F.col("text").rlike(r"(?U)\S"))
    return rows.withColumn("text", without_number(F.col("text")))


def without_number(text: Column) -> Column:
    """A record's line without a line number and its mark (a colon, a tab, blanks) before the first brace."""
    before = F.substring_index(text, "{", 1)
    return F.when(F.contains(text, F.lit("{")) & before.rlike(r"^[ \t]*[0-9]+(:|\t| +)$"), F.substr(text, F.length(before) + 1)).otherwise(text)


def _maps(rows: list[dict[str, str]]) -> pa.MapArray:
    offsets, keys, values = [0], [], []
    for row in rows:
        keys += row
        values += row.values()
        offsets.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _finished(record: dict[str, str] | None, log: str | None, text: str, line: int, partials: int, problems: list[str]) -> tuple[dict[str, str], str, list[str]]:
    """The row of a record or, where there is none, of a bad line; what the parser has to say comes last."""
    row, shape, told = ({"parse.raw": text}, "", []) if record is None else logline.with_line(record, log)
    problems = problems + told
    return {**row, "parse.line": str(line), "parse.log_shape": shape, "parse.partials_joined": str(partials), "parse.problems": "; ".join(problems)}, shape, problems


def _whole_rows(batches):
    """Lines that are no fragments, to rows."""
    for b in batches:
        kept, fields, shapes, told = [], [], [], []
        for k, (text, line) in enumerate(zip(b.column("text").to_pylist(), b.column("line").to_pylist(), strict=True)):
            record, problem = logline.record_of(text)
            if record is not None and "_p" in record:
                continue
            log = record.get("log") if record is not None else None
            row, shape, problems = _finished(None if record is None else logline.cells(record), log if isinstance(log, str) else None, text, line, 0, [problem] if problem else [])
            kept.append(k)
            fields.append(row)
            shapes.append(shape)
            told.append(problems)
        some = b.take(pa.array(kept, pa.int64()))
        n = some.num_rows
        columns = [some.column("file"), some.column("line"), some.column("line"), pa.array([False] * n, pa.bool_()), pa.array([0] * n, pa.int32()), _maps(fields), pa.array(shapes, pa.string()), pa.array(told, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=list(_ROW))


def _pieces(batches):
    """Fragments among lines, with what brings them together."""
    for b in batches:
        kept, fields, more = [], [], []
        for k, text in enumerate(b.column("text").to_pylist()):
            record, _ = logline.record_of(text)
            if record is not None and "_p" in record:
                kept.append(k)
                fields.append(logline.cells(record))
                log = record.get("log")
                origin = [logline.written(v) for v in (record.get("filename") or record.get("pod"), record.get("container"), record.get("stream"))]
                more.append((log if isinstance(log, str) else None, fields[-1]["_p"], json.dumps(origin)))
        some = b.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(some.column(n) for n in ("file", "line", "text")), _maps(fields), *(pa.array([m[j] for m in more], pa.string()) for j in range(3))], names=["file", "line", "text", "fields", "log", "part", "source"])


def pieces(lines: DataFrame) -> DataFrame:
    """The fragments among lines (file, line, text); lines that cannot be fragments are left to Spark's own filter."""
    likely = F.contains("text", F.lit('_p"')) | F.contains("text", F.lit("\\u"))
    return lines.where(likely).select("file", "line", "text").mapInArrow(_pieces, PIECE)


def join_fragments(found: DataFrame) -> DataFrame:
    """Fragments joined: line is the first one's, place orders the output, partials counts fragments; a fragment nothing ends stays, last."""
    ends = (F.col("part") != "P").cast("int")
    order = Window.partitionBy("file", "source").orderBy("line")
    turned = found.withColumn("turn", F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    all_of = Window.partitionBy("file", "source", "turn").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = turned.withColumns({
        "ended": F.max(ends).over(all_of) == 1, "size": F.count("*").over(all_of), "from": F.min("line").over(all_of),
        "joined": F.array_join(F.collect_list(F.coalesce(F.element_at("fields", "log"), F.lit(""))).over(all_of), ""),
    })
    several = F.col("ended") & (F.col("size") > 1)
    with_log = F.map_contains_key("fields", "log")
    own = F.when(with_log, F.transform_values("fields", lambda k, v: F.when(k == "log", F.col("joined")).otherwise(v))).otherwise(F.map_concat("fields", F.create_map(F.lit("log"), F.col("joined"))))
    return turned.where("not ended or part <> 'P'").select(
        "file", F.when(F.col("ended"), F.col("from")).otherwise(F.col("line")).alias("line"), "text", F.when(several, own).otherwise(F.col("fields")).alias("fields"),
        F.when(several, F.col("joined")).otherwise(F.col("log")).alias("log"), F.col("line").alias("place"), (~F.col("ended")).alias("late"),
        F.when(several, F.col("size") - 1).otherwise(0).cast("int").alias("partials"), F.when(~F.col("ended"), F.lit(UNFINISHED)).alias("extra"),
    )


def _joined_rows(batches):
    """Joined fragments to rows."""
    for b in batches:
        made = [
            _finished(dict(fields), log, text, line, partials, [extra] if extra else [])
            for text, fields, log, line, partials, extra in zip(*(b.column(n).to_pylist() for n in ("text", "fields", "log", "line", "partials", "extra")), strict=True)
        ]
        columns = [*(b.column(n) for n in _ROW[:5]), _maps([m[0] for m in made]), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=list(_ROW))


def structure(lines: DataFrame) -> DataFrame:
    """Lines (file, line, text) to rows (file, line, place, late, partials, fields, shape, problems): fields in order, those of parse.* last. A line is parsed once; only fragments meet others."""
    whole = lines.select("file", "line", "text").mapInArrow(_whole_rows, ROW)
    return whole.unionByName(join_fragments(pieces(lines)).mapInArrow(_joined_rows, ROW))


def key_order(row_maps: DataFrame, fields: str = "fields") -> DataFrame:
    """(key, ord): the union of keys by first appearance, parse.* last."""
    keyed = row_maps.select("file", "late", "place", F.posexplode(F.map_keys(fields)).alias("at", "key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("file", "late", "place", "at")).alias("first"))
    by = Window.orderBy(F.startswith("key", F.lit("parse.")), "first")
    return first.select("key", F.row_number().over(by).alias("ord"))  # as many rows as columns


def wide(row_maps: DataFrame) -> DataFrame:
    """One text column a key; what a record lacks is empty."""
    names = [r["key"] for r in key_order(row_maps).orderBy("ord").collect()]
    ordered = row_maps.orderBy("file", "late", "place")
    return ordered.select(*[F.coalesce(F.element_at("fields", F.lit(n)), F.lit("")).alias(n) for n in names])


def write(row_maps: DataFrame, jsonl: str, table: str) -> None:
    row_maps.orderBy("file", "late", "place").select(F.to_json("fields")).write.mode("overwrite").text(jsonl)
    wide(row_maps).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(table)


def tallies(row_maps: DataFrame, by_file: bool = True) -> DataFrame:
    """(file, facet, name, n, first): counts of records, fragments, shapes, levels, sources, events, problems and fields; without by_file for all files at once."""
    f = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    item = lambda facet, name, n=None: F.struct(F.lit(facet).alias("facet"), name.alias("name"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    source = F.array_join(F.filter(F.array(f("namespace"), f("container")), lambda x: x != ""), "/")
    event = F.left(F.when(f("log.event") != "", f("log.event")).otherwise(f("log.message")), F.lit(80))
    filled = F.map_keys(F.map_filter("fields", lambda k, v: ~F.startswith(k, F.lit("parse.")) & (v != "")))
    items = F.concat(
        F.array(item("records", F.lit("")), item("partials", F.lit(""), F.col("partials")), item("shapes", F.when(F.col("shape") == "", "not parsed").otherwise(F.col("shape"))), item("sources", source)),
        F.filter(F.array(item("levels", f("log.level")), item("events", event)), lambda x: x["name"] != ""),
        F.transform("problems", lambda p: item("problems", F.substring_index(p, ":", 1))),
        F.transform(filled, lambda k: item("fields", k)),
    )
    keys = ["file"] if by_file else []
    exploded = row_maps.select("file", "late", "place", F.inline(items))
    return exploded.groupBy(*keys, "facet", "name").agg(F.sum("n").alias("n"), F.min(F.struct("file", "late", "place")).alias("first"))


#: Names of a facet that a summary shows; of the others all.
SHOWN = {"sources": 6, "events": 8}


def shown_tallies(counted: DataFrame, by_file: bool = True) -> DataFrame:
    """The tallies that a summary shows: of each facet the commonest names, ties by first appearance, with `kinds`, how many there are."""
    keys = ["file", "facet"] if by_file else ["facet"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    most = F.coalesce(*[F.when(F.col("facet") == facet, n) for facet, n in SHOWN.items()], F.lit(1_000))
    kinds = F.count("*").over(Window.partitionBy(*keys))
    return counted.withColumns({"rank": rank, "kinds": kinds}).where(F.col("rank") <= most)


def summary(counted: list) -> list[str]:
    """Lines for people from the collected shown_tallies of one file, or of all."""
    facets: dict[str, list] = {}
    for r in sorted(counted, key=lambda r: r["rank"]):
        facets.setdefault(r["facet"], []).append(r)

    def line(facet):
        have = facets.get(facet, [])
        more = have[0]["kinds"] - len(have) if have else 0
        return ", ".join([*(f"{r['name'] or '(none)'} {r['n']}" for r in have), *([f"and {more} more"] if more else [])]) or "none"

    fields = sorted(facets.get("fields", []), key=lambda r: (-r["n"], r["name"]))
    out = [f"  records              {sum(r['n'] for r in facets.get('records', []))}"]
    if partials := sum(r["n"] for r in facets.get("partials", [])):
        out.append(f"  fragments joined     {partials}")
    labels = (("shapes", "log line shapes"), ("levels", "levels"), ("sources", "sources"), ("events", "commonest events"), ("problems", "problems"))
    out += [f"  {label:<19}  {line(facet)}" for facet, label in labels if facet in facets or facet in ("shapes", "sources", "problems")]
    return [*out, f"  fields               {fields[0]['kinds'] if fields else 0}", *(f"      {r['n']:>8}  {r['name']}" for r in fields)]


def one_line(path: str, counted: list) -> str:
    """A file's summary in a line."""
    of = lambda facet: sum(r["n"] for r in counted if r["facet"] == facet)
    return f"{path}: {of('records')} records, {of('partials')} fragments joined, {of('problems')} problems"


def find_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kept, reason): files named are taken; of directories the files directly inside whose first line is a record, not hidden ones nor our own output. One job looks into all files."""
    from ..sources.files import listing
    from ..sources.lines import first_lines

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, bool, str | None]] = []
    inside: list[str] = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        system = where.getFileSystem(conf)
        if not system.exists(where):
            out.append((p, False, "no such file or directory"))
        elif system.getFileStatus(where).isFile():
            out.append((p, True, None))
        else:
            inside += [r["path"] for r in listing(spark, p).collect() if not (r["name"].startswith(".") or r["name"].endswith(OUTPUTS))]
    named = spark.createDataFrame(out, "path string, kept boolean, reason string")
    if not inside:
        return named
    record = F.startswith(F.ltrim(without_number(F.col("text"))), F.lit("{"))
    seen = first_lines(spark, inside).select(F.col("file").alias("path"), F.coalesce(record, F.lit(False)).alias("kept"))
    return seen.withColumn("reason", F.when(~F.col("kept"), "its first line is not a JSON record")).unionByName(named)


def without_collisions(sources: DataFrame) -> DataFrame:
    """Kept sources with `first`: false where another of the same file name comes before, as both would write one output."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    order = Window.partitionBy("stem").orderBy("path")
    return sources.where("kept").withColumn("stem", stem).withColumn("first", F.row_number().over(order) == 1)
