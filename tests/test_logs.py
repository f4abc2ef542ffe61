"""Records, fragments, line shapes, conflicts, sinks and tallies."""

import json

import pytest

from quern.functions import logline
from quern.operators import podlogs
from quern.plans import manifest


def structured(spark, texts, file="f"):
    rows = [(file, n, t) for n, t in enumerate(texts, 1)]
    return podlogs.structure(spark.createDataFrame(rows, "file string, line long, text string"))


def record(log, **more):
    return json.dumps({"log": log, **more})


def test_numbers_keep_their_text():
    record, _ = logline.record_of('{"a": 1.50, "b": 1e5, "c": 1786665594.023551, "d": null, "e": true, "f": {"x": [1, "ä"]}}')
    assert {k: logline.written(v) for k, v in record.items()} == {"a": "1.50", "b": "1e5", "c": "1786665594.023551", "d": "", "e": "true", "f": '{"x":["1","ä"]}'}
    assert logline.record_of("{this is not json")[1].startswith("not-json: ") and logline.record_of("[1]")[1].endswith("not an object")


def test_equations_are_found_from_their_signs():
    assert logline.equations('9ab=1 é=2 x.y-z="a \\" b" q="open c==d') == ([("ab", "1"), ("x.y-z", '"a \\" b"'), ("q", '"open'), ("c", "=d")], len("9 é=2"))
    assert logline.equations("no pairs = here =") == ([], len("no pairs = here ="))


@pytest.mark.parametrize(
    ("line", "shape", "fields"),
    [
        ("2026-08-13 23:59:54  -  INFO  -  hello  -  {\"a\": 1}", "logging", {"log.time": "2026-08-13 23:59:54", "log.level": "INFO", "log.message": "hello"}),
        ("2026-08-13T23:59:54.1Z - warn - bad payload - {not json - {\"a\": 1}", "logging", {"log.message": "bad payload - {not json"}),
        ('{"ts": 1.50, "severity": "x", "msg": null}', "json", {"log.time": "1.50", "log.level": "x"}),
        ('level=info msg="a \\"b\\"" k=v', "logfmt", {"log.level": "info", "log.msg": 'a "b"', "log.message": 'a "b"', "log.k": "v"}),
        ("a=1 but this is mostly words b=2 and more of them", "text", {}), ("  plain ", "text", {"log.message": "plain"}),
    ],
)
def test_shapes(line, shape, fields):
    found, _, got = logline.shaped(line)
    assert got == shape and found.items() >= fields.items()


def test_message_key_wins_over_line_time():
    found, _, _ = logline.shaped("2026-08-13 23:59:54 - INFO - called | time=9 | other=1")
    assert found["log.time"] == "9" and found["log.event"] == "called"


def test_fragments(spark):
    texts = [record("a", _p="P", pod="1"), record("x", _p="P", pod="2"), record("b", _p="P", pod="1"), record("whole"), record("c", _p="F", pod="1"), record("y", _p="F", pod="2"), record("lost", _p="P", pod="3"), record("one", _p="F", pod="1"), "{bad"]
    got = structured(spark, texts).orderBy("late", "place").collect()
    assert [(r["fields"].get("log"), r["line"], r["partials"]) for r in got] == [("whole", 4, 0), ("abc", 1, 2), ("xy", 2, 1), ("one", 8, 0), (None, 9, 0), ("lost", 7, 0)]
    assert got[5]["problems"] == [podlogs.UNFINISHED] and got[4]["fields"]["parse.raw"] == "{bad" and got[4]["problems"][0].startswith("not-json")


def test_conflict_and_agreement(spark):
    (r,) = structured(spark, [record('2026-08-13 23:59:54 - INFO - m - {"app": "x", "same": 1, "new": true}', app="y", same=1)]).collect()
    assert r["fields"]["app"] == "y" and r["fields"]["context.app"] == "x" and r["fields"]["new"] == "true" and "context.same" not in r["fields"]
    assert r["problems"] == ["conflict: app is 'y' outside the log line and 'x' inside it"]


def test_files_sinks_and_tallies(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_bytes(b"\n   12\t" + record("x", b=1).encode() + b"\n\n" + record("y", c="é", namespace="n", container="k").encode() + b"\n")
    (tmp_path / "notes.txt").write_text("hello\n")
    (tmp_path / ".hidden").write_text("{}\n")
    (tmp_path / "a.parsed.jsonl").write_text("{}\n")
    found = podlogs.find_sources(spark, [f"file://{tmp_path}", f"file://{tmp_path}/gone"])
    assert [(r["path"].rsplit("/", 1)[-1], r["kept"]) for r in found.collect()] == [("a.txt", True), ("notes.txt", False), ("gone", False)]
    rows = podlogs.structure(podlogs.read_lines(spark, [str(a)]))
    assert [r["line"] for r in rows.orderBy("line").collect()] == [2, 4]
    wide = podlogs.wide(rows)
    assert wide.columns == ["log", "b", "log.message", "c", "namespace", "container", "parse.line", "parse.log_shape", "parse.partials_joined", "parse.problems"]
    assert [r["c"] for r in wide.collect()] == ["", "é"]
    podlogs.write(rows, f"file://{tmp_path}/j", f"file://{tmp_path}/t")
    assert json.loads(spark.read.text(f"file://{tmp_path}/j").first()[0])["b"] == "1"
    counted = podlogs.shown_tallies(podlogs.tallies(rows, by_file=False), by_file=False).collect()
    assert {r["name"]: r["n"] for r in counted if r["facet"] == "sources"} == {"": 1, "n/k": 1}
    text = "\n".join(podlogs.summary(counted))
    assert "records              2" in text and "problems             none" in text and "(none) 1, n/k 1" in text


def test_one_output_a_name(spark):
    sources = spark.createDataFrame([("/a/x.txt", True, None), ("/b/x.txt", True, None), ("/b/y.txt", True, None)], "path string, kept boolean, reason string")
    assert {r["path"]: r["first"] for r in podlogs.without_collisions(sources).collect()} == {"/a/x.txt": True, "/b/x.txt": False, "/b/y.txt": True}


def test_manifest_is_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    assert manifest.read(spark, folder) is None
    for n in (2, 3, 4):
        manifest.save(spark.range(n), folder)
    (tmp_path / "m" / "manifest-9").mkdir()  # a version that was never finished does not count
    assert manifest.read(spark, folder).count() == 4 and manifest.versions(spark, folder) == [2, 3]
    manifest.clear(spark, folder)
    assert manifest.read(spark, folder) is None


def test_entry_and_queries_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
