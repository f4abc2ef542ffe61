"""Queries over the driver's tables, one for each operator or group of them, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import podlogs
from .operators import profile as P
from .plans import manifest
from .settings import NULL_WORDS, NUMBER, WATCHED_WORDS
from .sources.scratch import new_folder

PROFILED = {"customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "orders": ("o_orderkey", "o_orderstatus", "o_orderpriority"), "part": ("p_name", "p_brand", "p_type", "p_size"), "events": ("user_id", "event_type", "props"), "documents": ("lang", "source")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _freq(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Frequencies of the profiled columns of tables, with table_name."""
    each = [P.frequencies(P.cells(P.as_text(table(spark, sf_dir, n), list(PROFILED[n])))).withColumn("table_name", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, each)


KEYS = ("table_name", "column_name")


def _cells_sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '') AS value FROM {n}" for n in names for c in PROFILED[n])


_NULLS = ", ".join(f"'{w}'" for w in NULL_WORDS)
_NUM = "CASE WHEN regexp_matches(value, '" + NUMBER + "') THEN TRY_CAST(trim(value) AS DOUBLE) END"


def profile_basic(spark, sf_dir):
    made = P.profile(_freq(spark, sf_dir, ["customer", "orders", "documents"]), KEYS)
    return made.select(*KEYS, "rows_seen", "empty_count", "null_like_text_count", "filled_in_count")


BASIC_SQL = f"""SELECT table_name, column_name, count(*) AS rows_seen, count(*) FILTER (value = '') AS empty_count,
count(*) FILTER (lower(value) IN ({_NULLS})) AS null_like_text_count, count(*) FILTER (value <> '') AS filled_in_count
FROM ({_cells_sql(['customer', 'orders', 'documents'])}) GROUP BY 1, 2"""


def profile_lengths(spark, sf_dir):
    made = P.profile(_freq(spark, sf_dir, ["part", "documents", "events"]), KEYS)
    return made.select(*KEYS, "shortest_value_length", "longest_value_length")


LENGTHS_SQL = f"""SELECT table_name, column_name, CAST(min(length(value)) FILTER (value <> '') AS INTEGER) AS shortest_value_length,
CAST(max(length(value)) FILTER (value <> '') AS INTEGER) AS longest_value_length FROM ({_cells_sql(['part', 'documents', 'events'])}) GROUP BY 1, 2"""


def profile_distinct_capped(spark, sf_dir):
    made = P.profile(_freq(spark, sf_dir, ["customer", "orders"]), KEYS, cap=1000)
    return made.select(*KEYS, "distinct_count", "distinct_count_is_at_least")


DISTINCT_SQL = f"""SELECT table_name, column_name, least(count(DISTINCT value) FILTER (value <> ''), 1000) AS distinct_count,
count(DISTINCT value) FILTER (value <> '') > 1000 AS distinct_count_is_at_least FROM ({_cells_sql(['customer', 'orders'])}) GROUP BY 1, 2"""


def profile_numbers(spark, sf_dir):
    made = P.profile(_freq(spark, sf_dir, ["customer", "part", "events"]), KEYS)
    return made.select(*KEYS, "number_count", "not_a_number_count", "smallest_number", "largest_number", "is_all_numbers")


NUMBERS_SQL = f"""SELECT table_name, column_name, count(num) AS number_count, count(*) FILTER (value <> '') - count(num) AS not_a_number_count,
min(num) AS smallest_number, max(num) AS largest_number, count(*) FILTER (value <> '') > 0 AND count(num) = count(*) FILTER (value <> '') AS is_all_numbers
FROM (SELECT *, {_NUM} AS num FROM ({_cells_sql(['customer', 'part', 'events'])})) GROUP BY 1, 2"""


def top_values(spark, sf_dir):
    freq = _freq(spark, sf_dir, ["orders", "part", "events"])
    filled = freq.where("value <> ''").groupBy(*KEYS).agg(F.sum("n").alias("filled"))
    top = P.top_values(freq, KEYS, 5).join(filled, list(KEYS))
    return top.select(*KEYS, "value", "n", "rank", F.round(F.col("n") / F.col("filled"), 6).alias("share_of_filled"))


_TOP = """SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY table_name, column_name) AS filled
FROM (SELECT table_name, column_name, value, count(*) AS n FROM ({cells}) WHERE value <> '' GROUP BY 1, 2, 3)"""
TOP_SQL = f"""SELECT table_name, column_name, value, n, CAST(rank AS INTEGER) AS rank, round(n / filled, 6) AS share_of_filled
FROM ({_TOP.format(cells=_cells_sql(['orders', 'part', 'events']))}) WHERE rank <= 5"""


def coverage_suppression(spark, sf_dir):
    got = P.coverage(_freq(spark, sf_dir, ["part", "orders", "customer"]), KEYS, 10)
    return got.select(*KEYS, "shown_count", "filled_in_count", F.round("coverage", 6).alias("coverage"), "is_suppressed")


COVERAGE_SQL = f"""SELECT table_name, column_name, CAST(sum(n) FILTER (rank <= 10) AS BIGINT) AS shown_count, CAST(max(filled) AS BIGINT) AS filled_in_count,
round(sum(n) FILTER (rank <= 10) / max(filled), 6) AS coverage, sum(n) FILTER (rank <= 10) / max(filled) < 0.10 AS is_suppressed
FROM ({_TOP.format(cells=_cells_sql(['part', 'orders', 'customer']))}) GROUP BY 1, 2"""

_ODD = {"blank": "''", "constant": "'CONST'", "nearly": "CASE WHEN o_orderkey % 200 = 0 THEN 'odd' ELSE 'x' END", "half": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'same' END", "varied": "o_orderpriority", "na_words": "CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE 'v' END"}


def constant_empty_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _ODD.items()])
    made = P.profile(P.frequencies(P.cells(P.as_text(orders))), ("column_name",))
    return made.select("column_name", "is_all_empty", "holds_one_value", F.round("single_value_share", 4).alias("single_value_share"), "null_like_text_count")


_ODD_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {e} AS value FROM orders" for c, e in _ODD.items())
CONSTANT_SQL = f"""SELECT column_name, sum(n) FILTER (value = '') IS NOT NULL AND sum(n) FILTER (value = '') = sum(n) AS is_all_empty,
coalesce(max(n) FILTER (value <> ''), 0) / sum(n) >= 0.99 AS holds_one_value, round(coalesce(max(n) FILTER (value <> ''), 0) / sum(n), 4) AS single_value_share,
CAST(coalesce(sum(n) FILTER (lower(value) IN ({_NULLS})), 0) AS BIGINT) AS null_like_text_count
FROM (SELECT column_name, value, count(*) AS n FROM ({_ODD_CELLS}) GROUP BY 1, 2) GROUP BY 1"""

_COLUMNS = {n: c for n, c in PROFILED.items()} | {"supplier": ("s_suppkey", "s_name", "s_nationkey"), "nation": ("n_nationkey", "n_name")}


def identifier_name_watch(spark, sf_dir):
    rows = [(t, c) for t, cs in _COLUMNS.items() for c in cs]
    names = spark.createDataFrame(rows, "table_name string, column_name string").withColumn("words", T.watched_words(F.col("column_name")))
    return names.where(F.size("words") > 0).select("table_name", "column_name", F.array_join("words", ",").alias("matched_words"))


_WATCH = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name" for t, cs in _COLUMNS.items() for c in cs)
WATCH_SQL = f"""SELECT table_name, column_name, string_agg(word, ',' ORDER BY ord) AS matched_words FROM ({_WATCH}),
(SELECT unnest([{", ".join(f"'{w}'" for w in WATCHED_WORDS)}]) AS word, unnest(range({len(WATCHED_WORDS)})) AS ord) WHERE contains(lower(column_name), word) GROUP BY 1, 2"""

_SHAPES = {"user_id": ("events", "CAST(user_id AS VARCHAR)"), "c_name": ("customer", "c_name"), "page_path": ("pages", "regexp_replace(url, '^[a-z]+://[^/?#]*', '')"), "mixed_name": ("events", "CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(user_id AS VARCHAR) WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END"), "plain": ("nation", "n_name")}


def identifier_shape(spark, sf_dir):
    freq = []
    for c, (t, e) in _SHAPES.items():
        cells = table(spark, sf_dir, t).select(F.lit(c).alias("column_name"), F.expr(e.replace("VARCHAR", "STRING")).alias("value"))
        freq.append(P.frequencies(cells, ("column_name",)))
    found = P.concerns(P.profile(reduce(DataFrame.unionByName, freq), ("column_name",)), ("column_name",))
    return found.select("column_name", "watched_by_name", "values_seen", "all_digit_share", "path_like_share", "verdict", P.needs_attention(F.col("verdict")).alias("needs_attention"))


_SHAPE_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {e} AS value FROM {t}" for c, (t, e) in _SHAPES.items())
_WATCHED = " OR ".join(f"contains(lower(column_name), '{w}')" for w in WATCHED_WORDS)
SHAPE_SQL = f"""SELECT column_name, watched_by_name, seen AS values_seen, round(digits / seen, 4) AS all_digit_share, round(paths / seen, 4) AS path_like_share, verdict,
verdict LIKE '%NOT consistent%' OR verdict LIKE '%path%' AS needs_attention FROM (SELECT *, CASE WHEN paths > 0 THEN 'contains paths, which may hold usernames'
WHEN digits = seen THEN 'all digits, consistent with having been anonymised' ELSE 'contains letters, NOT consistent with having been anonymised' END AS verdict
FROM (SELECT column_name, ({_WATCHED}) AS watched_by_name, count(*) AS seen, count(*) FILTER (regexp_matches(value, '^[0-9]+$')) AS digits, count(*) FILTER (starts_with(value, '/')) AS paths
FROM ({_SHAPE_CELLS}) WHERE value <> '' GROUP BY 1, 2)) WHERE watched_by_name OR paths > 0"""


def preview_vs_full(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    columns = list(PROFILED["orders"])
    of = lambda df: P.profile(P.frequencies(P.cells(P.as_text(df, columns))), ("column_name",))
    return P.compare(of(orders.orderBy("o_orderkey").limit(1000)), of(orders)).select("column_name", "preview_distinct_count", "full_distinct_count", "preview_number_count", "full_number_count", "verdict_changes")


def _side(source: str) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {source}" for c in PROFILED["orders"])
    return f"""SELECT column_name, least(count(*), 1000) AS d, CAST(coalesce(sum(n) FILTER (regexp_matches(value, '{NUMBER}')), 0) AS BIGINT) AS num, max(n) / sum(n) >= 0.99 AS one
    FROM (SELECT column_name, value, count(*) AS n FROM ({cells}) GROUP BY 1, 2) GROUP BY 1"""


PREVIEW_SQL = f"""WITH first_rows AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) SELECT p.column_name, p.d AS preview_distinct_count, f.d AS full_distinct_count,
p.num AS preview_number_count, f.num AS full_number_count, p.one <> f.one AS verdict_changes FROM ({_side('first_rows')}) p JOIN ({_side('orders')}) f USING (column_name)"""


def file_rollup(spark, sf_dir):
    from .plans import directory

    freq = _freq(spark, sf_dir, ["customer", "orders", "part", "events"]).withColumnRenamed("table_name", "file")
    made = P.profile(freq, ("file", "position", "column_name"))
    rolled = directory.rollup(made)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rolled.select("file", "rows", F.col("columns").alias("n_columns"), joined("empty_columns"), joined("constant_columns"), joined("columns_to_check"))


_PLACED = " UNION ALL ".join(f"SELECT '{n}' AS file, {k} AS position, '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '') AS value FROM {n}" for n in ("customer", "orders", "part", "events") for k, c in enumerate(PROFILED[n]))
ROLLUP_SQL = f"""SELECT file, CAST(max(total) AS BIGINT) AS rows, count(*) AS n_columns, coalesce(string_agg(column_name, ',' ORDER BY position) FILTER (empty = total), '') AS empty_columns,
coalesce(string_agg(column_name, ',' ORDER BY position) FILTER (top / total >= 0.99), '') AS constant_columns,
coalesce(string_agg(column_name, ',' ORDER BY position) FILTER (paths > 0 OR (({_WATCHED}) AND digits < total - empty)), '') AS columns_to_check FROM (SELECT file, position, column_name, sum(n) AS total,
coalesce(sum(n) FILTER (value = ''), 0) AS empty, coalesce(max(n) FILTER (value <> ''), 0) AS top, coalesce(sum(n) FILTER (regexp_matches(value, '^[0-9]+$')), 0) AS digits,
coalesce(sum(n) FILTER (starts_with(value, '/')), 0) AS paths FROM (SELECT file, position, column_name, value, count(*) AS n FROM ({_PLACED}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1"""

_KINDS = "CASE WHEN {k} % 3 = 0 THEN 'report' WHEN {k} % 3 = 1 THEN 'draft' ELSE 'markdown' END"


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string")).alias("name"))
    outputs = table(spark, sf_dir, "labels").selectExpr("doc_id AS stem", "explode(CASE WHEN quality = 1 THEN array('report', 'draft', 'markdown') ELSE array('report', 'draft') END) AS kind")
    return docs, outputs


def skip_existing_anti(spark, sf_dir):
    return manifest.to_read(*_files(spark, sf_dir)).select("stem", "name")


def reuse_semi(spark, sf_dir):
    return manifest.to_skip(*_files(spark, sf_dir)).select("stem", "name")


ANTI_SQL = "SELECT doc_id AS stem, source || '-' || CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"
SEMI_SQL = "SELECT doc_id AS stem, source || '-' || CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def outcomes_in_order(spark, sf_dir):
    files, outputs = _files(spark, sf_dir)
    fresh = manifest.to_read(files, outputs).select("stem", F.lit("read").alias("status"))
    reused = manifest.to_skip(files, outputs).select("stem", F.lit("skipped").alias("status"))
    return manifest.in_order(fresh, reused, files).select("stem", "status")


ORDER_SQL = "SELECT doc_id AS stem, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'skipped' ELSE 'read' END AS status FROM documents"


def manifest_validity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    common = ["1 AS format", "',' AS separator", "1000 AS cap", "0 AS preview", "true AS identifiers"]
    wanted = pages.selectExpr("url || '#' || CAST(page_id AS STRING) AS path", "CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id END AS size", "page_id % 7 AS modified", *common)
    saved = pages.where("page_id % 2 = 0").selectExpr("url || '#' || CAST(page_id AS STRING) AS path", "CASE WHEN page_id % 5 = 0 THEN page_id + 1 ELSE page_id END AS size", "page_id % 7 AS modified", "CASE WHEN page_id % 13 = 0 THEN 0 ELSE 1 END AS format", "',' AS separator", "CASE WHEN page_id % 3 = 0 THEN 500 ELSE 1000 END AS cap", "0 AS preview", "true AS identifiers", "page_id % 4 AS rows_done")
    return manifest.validity(wanted, saved).select("path", "refusal")


VALIDITY_SQL = """SELECT url || '#' || CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 2 <> 0 THEN 'nothing saved' WHEN page_id % 13 = 0 THEN 'saved by another version'
WHEN page_id % 11 = 0 THEN 'the file is gone' WHEN page_id % 5 = 0 THEN 'the file has changed' WHEN page_id % 3 = 0 THEN 'the settings have changed'
WHEN page_id % 4 <= 0 THEN 'no progress saved' END AS refusal FROM pages"""


def _log_lines(spark, sf_dir) -> DataFrame:
    """Lines of a container log made from events, in all four shapes."""
    message = F.concat(F.lit("/api/"), F.col("event_type"), F.lit(": done | userName=u"), F.col("user_id").cast("string"), F.lit("| kind = "), F.col("event_type"), F.lit(" |a note|kind=again"))
    log = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("2026-01-02 03:04:05  -  INFO  -  "), message, F.lit('  -  {"user": "'), F.col("user_id").cast("string"), F.lit('", "pod": "p1"}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"ts": 1786665594.023551, "severity": "warn", "msg": "'), F.col("event_type"), F.lit('", "x": 1.50}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('level=error msg="it failed" kind='), F.col("event_type")))
        .otherwise(F.concat(F.lit("plain text of "), F.col("event_type")))
    )
    record = F.to_json(F.struct(log.alias("log"), F.lit("ns").alias("namespace"), F.col("event_type").alias("container"), F.lit("p0").alias("pod"), F.col("user_id").alias("uid")))
    events = table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("part"), (F.col("event_id") % 2).cast("string")).alias("file"), F.col("event_id").alias("line"), record.alias("text"))


_SHAPE_OF = "CASE event_id % 4 WHEN 0 THEN 'logging' WHEN 1 THEN 'json' WHEN 2 THEN 'logfmt' ELSE 'text' END"


def log_shapes(spark, sf_dir):
    got = podlogs.structure(_log_lines(spark, sf_dir))
    f = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    return got.select("line", "shape", f("log.level").alias("level"), f("log.time").alias("time"), f("log.event").alias("event"), f("log.message").alias("message"), f("log.kind").alias("kind"), f("x").alias("x"), f("uid").alias("uid"))


SHAPES_SQL = f"""SELECT event_id AS line, {_SHAPE_OF} AS shape, CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE '' END AS level,
CASE event_id % 4 WHEN 0 THEN '2026-01-02 03:04:05' WHEN 1 THEN '1786665594.023551' ELSE '' END AS time,
CASE event_id % 4 WHEN 0 THEN '/api/' || event_type || ': done | a note' ELSE '' END AS event,
CASE event_id % 4 WHEN 0 THEN '/api/' || event_type || ': done | userName=u' || CAST(user_id AS VARCHAR) || '| kind = ' || event_type || ' |a note|kind=again'
WHEN 1 THEN event_type WHEN 2 THEN 'it failed' ELSE 'plain text of ' || event_type END AS message,
CASE WHEN event_id % 4 IN (0, 2) THEN event_type ELSE '' END AS kind, CASE WHEN event_id % 4 = 1 THEN '1.50' ELSE '' END AS x, CAST(user_id AS VARCHAR) AS uid FROM events"""


def context_merge(spark, sf_dir):
    got = podlogs.structure(_log_lines(spark, sf_dir)).where("shape = 'logging'")
    f = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    return got.select("line", f("user").alias("user"), f("pod").alias("pod"), f("context.pod").alias("context_pod"), f("parse.problems").alias("problems"))


CONTEXT_SQL = """SELECT event_id AS line, CAST(user_id AS VARCHAR) AS user, 'p0' AS pod, 'p1' AS context_pod, 'conflict: pod is ''p0'' outside the log line and ''p1'' inside it' AS problems FROM events WHERE event_id % 4 = 0"""


def json_props_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lines = events.select(F.lit("e").alias("file"), F.col("event_id").alias("line"), F.col("props").alias("text"))
    f = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    return podlogs.structure(lines).select(F.col("line").alias("event_id"), f("k").alias("k"), f("parse.problems").alias("problem"))


PROPS_SQL = "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS problem FROM events"


def message_pairs(spark, sf_dir):
    message = F.expr("event_type || ' done | user=' || CAST(user_id AS STRING) || '|user=twice| bad key=1 |' || CASE WHEN event_id % 3 = 0 THEN 'more' ELSE '' END")
    pairs = table(spark, sf_dir, "events").select("event_id", T.message_pairs(message).alias("m"))
    return pairs.select("event_id", F.element_at("m", F.lit("log.user")).alias("user"), F.element_at("m", F.lit("log.event")).alias("event"), F.size("m").alias("n"))


PAIRS_SQL = """SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type || ' done | bad key=1' || CASE WHEN event_id % 3 = 0 THEN ' | more' ELSE '' END AS event, 2 AS n FROM events"""


def _fragments(spark, sf_dir) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    part = F.expr("CASE WHEN turn % 3 = 2 THEN 'F' ELSE 'P' END")
    record = F.to_json(F.struct(F.col("text").alias("log"), part.alias("_p"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("pod")))
    return talks.select(F.lit("t").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"), record.alias("text"))


def fragment_join(spark, sf_dir):
    joined = podlogs.join_fragments(podlogs.pieces(_fragments(spark, sf_dir)))
    return joined.select("line", "log", F.col("partials").alias("partials"), F.col("late").alias("unfinished"))


FRAGMENT_SQL = """WITH lines AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS line, turn % 3 <> 2 AS is_p FROM conversations),
turned AS (SELECT *, coalesce(sum(CASE WHEN is_p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM lines),
ended AS (SELECT *, bool_or(NOT is_p) OVER (PARTITION BY conv_id, grp) AS done FROM turned)
SELECT min(line) AS line, string_agg(text, '' ORDER BY line) AS log, CAST(count(*) - 1 AS INTEGER) AS partials, false AS unfinished FROM ended WHERE done GROUP BY conv_id, grp
UNION ALL SELECT line, text, 0, true FROM ended WHERE NOT done"""


def log_tallies(spark, sf_dir):
    return podlogs.tallies(podlogs.structure(_log_lines(spark, sf_dir))).select("file", "facet", "name", "n")


def log_tallies_total(spark, sf_dir):
    return podlogs.tallies(podlogs.structure(_log_lines(spark, sf_dir)), by_file=False).select("facet", "name", "n")


def log_tallies_shown(spark, sf_dir):
    return podlogs.shown_tallies(podlogs.tallies(podlogs.structure(_log_lines(spark, sf_dir)))).select("file", "facet", "name", "n", "rank", "kinds")


#: Fields that records of each shape have, in order; from the sixth on those of their lines.
_FIELDS = {
    0: "log namespace container pod uid log.time log.level log.message log.userName log.kind log.event user context.pod", 1: "log namespace container pod uid log.time log.level log.message ts severity msg x",
    2: "log namespace container pod uid log.level log.msg log.kind log.message", 3: "log namespace container pod uid log.message",
}
_EVENT = """left(CASE event_id % 4 WHEN 0 THEN '/api/' || event_type || ': done | a note' WHEN 1 THEN event_type WHEN 2 THEN 'it failed' ELSE 'plain text of ' || event_type END, 80)"""
_TALLY = f"""SELECT 'part' || CAST(event_id % 2 AS VARCHAR) AS file, event_id, 0 AS at, unnest(['records', 'partials', 'shapes', 'sources', 'levels', 'events', 'problems']) AS facet,
unnest(['', '', {_SHAPE_OF}, 'ns/' || event_type, CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE NULL END, {_EVENT}, CASE WHEN event_id % 4 = 0 THEN 'conflict' END]) AS name,
unnest([1, 0, 1, 1, 1, 1, 1]) AS n FROM events UNION ALL """ + " UNION ALL ".join(f"SELECT 'part' || CAST(event_id % 2 AS VARCHAR), event_id, 0, 'fields', unnest({names.split()}), 1 FROM events WHERE event_id % 4 = {k}" for k, names in _FIELDS.items())
TALLY_SQL = f"SELECT file, facet, name, CAST(sum(n) AS BIGINT) AS n FROM ({_TALLY}) WHERE name IS NOT NULL GROUP BY 1, 2, 3"
TALLY_TOTAL_SQL = f"SELECT facet, name, CAST(sum(n) AS BIGINT) AS n FROM ({_TALLY}) WHERE name IS NOT NULL GROUP BY 1, 2"
TALLY_SHOWN_SQL = f"""WITH c AS (SELECT file, facet, name, CAST(sum(n) AS BIGINT) AS n, min(event_id) AS first FROM ({_TALLY}) WHERE name IS NOT NULL GROUP BY 1, 2, 3)
SELECT file, facet, name, n, rank, kinds FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file, facet ORDER BY n DESC, first, name) AS INTEGER) AS rank, count(*) OVER (PARTITION BY file, facet) AS kinds FROM c)
WHERE rank <= CASE facet WHEN 'sources' THEN 6 WHEN 'events' THEN 8 ELSE 1000 END"""


def key_union(spark, sf_dir):
    return podlogs.key_order(podlogs.structure(_log_lines(spark, sf_dir))).select("key", "ord")


_PARSED = "parse.line parse.log_shape parse.partials_joined parse.problems"
_PLACED_KEYS = " UNION ALL ".join(f"SELECT event_id % 2 AS file, event_id, unnest({(names + ' ' + _PARSED).split()}) AS key, unnest(range({len((names + ' ' + _PARSED).split())})) AS place FROM events WHERE event_id % 4 = {k}" for k, names in _FIELDS.items())
KEY_UNION_SQL = f"""SELECT key, CAST(row_number() OVER (ORDER BY starts_with(key, 'parse.'), file, event_id, place) AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, event_id, place) AS k FROM ({_PLACED_KEYS})) WHERE k = 1"""
_NAMES = ("a.csv", "B.CSV.GZ", "c.csv.bz2", "d.Csv.xz", "e.csv.zip", "f.tar.gz", "g.parquet", "noext", ".hidden", "h.csv.csv", "i.v1.csv")


def suffix_stem_compression(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("name")).distinct()
    name = F.col("name")
    return names.select("name", T.csv_suffix(name).alias("suffix"), T.dataset_stem(name).alias("stem"), F.coalesce(T.compression(name), F.lit("")).alias("compression"))


SUFFIX_SQL = f"""SELECT name, regexp_extract(name, '(?i)\\.csv(\\.(gz|bz2|xz))?$') AS suffix, CASE WHEN regexp_matches(name, '(?i)\\.csv(\\.(gz|bz2|xz))?$') THEN regexp_replace(name, '(?i)\\.csv(\\.(gz|bz2|xz))?$', '')
WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem, regexp_extract(lower(name), '\\.(gz|bz2|xz)$', 1) AS compression
FROM (SELECT unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) AS name)"""


def format_helpers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size, seconds = F.col("n_chars") * F.col("n_chars") * F.col("doc_id"), F.col("n_chars") * 3
    return docs.select("doc_id", T.bytes_text(size).alias("size_text"), T.seconds_text(seconds).alias("seconds_text"), T.cut_end(F.col("source"), 4).alias("cut_end"), T.cut_start(F.concat("source", F.lit(".csv")), 7).alias("cut_start"))


_SIZE = "(n_chars * n_chars * doc_id)"
FORMAT_SQL = f"""SELECT doc_id, CASE {' '.join(f"WHEN {_SIZE} < 1024.0 ** {k + 1} THEN printf('%.1f {u}', {_SIZE} / 1024.0 ** {k})" for k, u in enumerate(('B', 'KB', 'MB', 'GB')))} ELSE printf('%.1f TB', {_SIZE} / 1024.0 ** 4) END AS size_text,
CASE WHEN n_chars * 3 < 60 THEN printf('%ds', n_chars * 3) WHEN n_chars * 3 < 3600 THEN printf('%dm%02ds', n_chars * 3 // 60, n_chars * 3 % 60) ELSE printf('%dh%02dm', n_chars * 3 // 3600, n_chars * 3 % 3600 // 60) END AS seconds_text,
CASE WHEN length(source) > 4 THEN source[:3] || '…' ELSE source END AS cut_end, CASE WHEN length(source || '.csv') > 7 THEN '...' || right(source || '.csv', 4) ELSE source || '.csv' END AS cut_start FROM documents"""


def markdown_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.table_cell(F.concat(F.lit(" a |\n"), F.col("text"))).cast("binary")).alias("cell_md5"))


CELL_SQL = r"""SELECT doc_id, md5(replace(regexp_replace(regexp_replace(' a |' || chr(10) || text, '\s+', ' ', 'g'), '^ | $', '', 'g'), '|', '\|')) AS cell_md5 FROM documents"""
_TYPES = ("sc:Text", "https://schema.org/Text", "Integer", "", "cr:a/b:c")


def short_type(spark, sf_dir):
    types = table(spark, sf_dir, "region").select(F.explode(F.array(*[F.lit(t) for t in _TYPES])).alias("given")).distinct()
    return types.select("given", T.short_type(F.col("given")).alias("short"))


SHORT_SQL = f"""SELECT given, split_part(split_part(given, '/', -1), ':', -1) AS short FROM (SELECT unnest([{", ".join(f"'{t}'" for t in _TYPES)}]) AS given)"""


def literal_csv_roundtrip(spark, sf_dir):
    """A table written as text, plain and compressed, read literally and profiled: all the same."""
    import bz2
    import gzip
    import lzma
    import os
    import shutil

    from .plans import directory
    from .sources.files import write_csv

    folder = new_folder(spark, "csv").removeprefix("file://").removeprefix("file:")  # the reader opens mounted paths
    os.makedirs(folder)
    plain = write_csv(table(spark, sf_dir, "customer").select(*PROFILED["customer"]).orderBy("c_custkey"), f"{folder}/customer.csv")
    paths = [plain]
    for suffix, opened in ((".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)):
        paths.append(plain + suffix)
        with open(plain, "rb") as source, opened(paths[-1], "wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
    made, _ = directory.profiled(directory.scanned(spark, paths))
    return made.select(F.regexp_extract("file", r"customer\.csv.*$", 0).alias("name"), "column_name", "rows_seen", "empty_count", "distinct_count", "number_count", "longest_value_length")


_CUSTOMER = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM customer" for c in PROFILED["customer"])
CSV_SQL = f"""SELECT name, column_name, count(*) AS rows_seen, count(*) FILTER (value = '') AS empty_count, least(count(DISTINCT value), 1000) AS distinct_count,
count(*) FILTER (regexp_matches(value, '{NUMBER}')) AS number_count, CAST(max(length(value)) AS INTEGER) AS longest_value_length
FROM ({_CUSTOMER}), (SELECT unnest(['customer.csv', 'customer.csv.gz', 'customer.csv.bz2', 'customer.csv.xz']) AS name) GROUP BY 1, 2"""


def stream_profile(spark, sf_dir):
    from .streaming import profile as stream

    folder = new_folder(spark, "stream")
    events = table(spark, sf_dir, "events")
    events.write.mode("overwrite").parquet(f"{folder}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new and goes on from the first one's state
        stream.run(rows, ["event_type", "user_id"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return P.profile(stream.frequencies(spark, f"{folder}/out"), ("column_name",)).select("column_name", "rows_seen", "distinct_count", "number_count")


STREAM_SQL = f"""SELECT column_name, count(*) AS rows_seen, least(count(DISTINCT value), 1000) AS distinct_count, count(*) FILTER (regexp_matches(value, '{NUMBER}')) AS number_count
FROM (SELECT 'event_type' AS column_name, event_type AS value FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events) GROUP BY 1"""


def stream_fragments(spark, sf_dir):
    from .streaming import fragments

    folder = new_folder(spark, "stream")
    talks = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS STRING) AS source", "conv_id * 1000 + turn AS line", "CASE WHEN turn % 3 = 2 THEN 'F' ELSE 'P' END AS part", "text AS log")
    talks.repartition("source").write.mode("overwrite").parquet(f"{folder}/in")  # a source's fragments come in one file
    rows = spark.readStream.schema(talks.schema).parquet(f"{folder}/in")
    query = fragments.join(rows, patience=None).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("not unfinished").select("line", "log", "partials")


STREAM_FRAGMENT_SQL = FRAGMENT_SQL.split("SELECT min(line)")[0] + "SELECT min(line) AS line, string_agg(text, '' ORDER BY line) AS log, CAST(count(*) - 1 AS INTEGER) AS partials FROM ended WHERE done GROUP BY conv_id, grp"

QUERIES = {
    f.__name__: f
    for f in (
        profile_basic, profile_lengths, profile_distinct_capped, profile_numbers, top_values, coverage_suppression, constant_empty_columns, identifier_name_watch, identifier_shape, preview_vs_full, file_rollup,
        skip_existing_anti, reuse_semi, outcomes_in_order, manifest_validity, log_shapes, context_merge, json_props_flatten, message_pairs, fragment_join, log_tallies, log_tallies_total, log_tallies_shown, key_union,
        suffix_stem_compression, format_helpers, markdown_cell, short_type, literal_csv_roundtrip, stream_profile, stream_fragments,
    )
}

ORACLE_SQL = {
    "profile_basic": BASIC_SQL, "profile_lengths": LENGTHS_SQL, "profile_distinct_capped": DISTINCT_SQL, "profile_numbers": NUMBERS_SQL, "top_values": TOP_SQL, "coverage_suppression": COVERAGE_SQL,
    "constant_empty_columns": CONSTANT_SQL, "identifier_name_watch": WATCH_SQL, "identifier_shape": SHAPE_SQL, "preview_vs_full": PREVIEW_SQL, "file_rollup": ROLLUP_SQL, "skip_existing_anti": ANTI_SQL,
    "reuse_semi": SEMI_SQL, "outcomes_in_order": ORDER_SQL, "manifest_validity": VALIDITY_SQL, "log_shapes": SHAPES_SQL, "context_merge": CONTEXT_SQL, "json_props_flatten": PROPS_SQL, "message_pairs": PAIRS_SQL,
    "fragment_join": FRAGMENT_SQL, "log_tallies": TALLY_SQL, "log_tallies_total": TALLY_TOTAL_SQL, "log_tallies_shown": TALLY_SHOWN_SQL, "key_union": KEY_UNION_SQL, "suffix_stem_compression": SUFFIX_SQL, "format_helpers": FORMAT_SQL,
    "markdown_cell": CELL_SQL, "short_type": SHORT_SQL, "literal_csv_roundtrip": CSV_SQL, "stream_profile": STREAM_SQL, "stream_fragments": STREAM_FRAGMENT_SQL,
}
