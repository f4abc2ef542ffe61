"""Literal reading, directories, drafts and Markdown."""

import bz2
import gzip
import json
import lzma

import pytest

from quern.plans import directory, draft, manifest, markdown
from quern.sources import files as S
from quern.sources import literal_csv as L


def lines(text):
    return list(L.rows_of(iter(text.splitlines(keepends=True))))


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("a,b\n1,2\n\n3\n", [["a", "b"], ["1", "2"], ["", ""], ["3", ""]]), ('a\n"x"y\n', [["a"], ["xy"]]), ("a,a,,b\n1,2,3,4", [["a", "a.1", "Unnamed: 2", "b"], ["1", "2", "3", "4"]]),
        ("a,b\n", [["a", "b"]]), ('a,b\n"li\nne","q""q"\n', [["a", "b"], ["li\nne", 'q"q']]), ("a\nNA\nnull\n\n", [["a"], ["NA"], ["null"], [""]]),
    ],
)
def test_literal_rows(text, rows):
    assert lines(text) == rows


@pytest.mark.parametrize(("text", "why"), [("a,b\n1,2,3\n", "3 cells"), ('a,b\n"x,1\n', "never closed"), ("", "empty"), ("a\n1\n1,\n", "2 cells")])
def test_bad_texts(text, why):
    with pytest.raises(ValueError, match=why):
        lines(text)


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    jobs = b"username,exit_code\nannika,0\nboris,1\n"
    (source / "jobs.csv").write_bytes(jobs)
    (source / "packed.csv.gz").write_bytes(gzip.compress(jobs))
    (source / "packed2.csv.bz2").write_bytes(bz2.compress(jobs))
    (source / "packed3.CSV.xz").write_bytes(lzma.compress(jobs))
    (source / "broken.csv").write_text('a,b,c\n1,"2,3\n')
    (source / "latin.csv").write_bytes(b"a\n\xff\n")
    (source / "dull.csv").write_text("varied,constant,blank\n" + "".join(f"{i},SAME,\n" for i in range(10)))
    (source / "header.csv").write_text("only,header\n")
    (source / "notes.txt").write_text("x")
    (source / "old.zip").write_text("x")
    (source / "sub").mkdir()
    return source


def test_directory(spark, folder, tmp_path):
    out = tmp_path / "out"
    text = directory.document(spark, f"file://{folder}", str(out))
    assert "# CSV files (8)" in text and "# Other files, not examined (2)" in text and "an archive may hold several files" in text
    assert text.index("broken.csv") < text.index("dull.csv") < text.index("jobs.csv")
    assert "never closed" in text and "COULD NOT READ: UnicodeDecodeError" in text
    assert text.count("check before sharing: username") == 4
    assert "empty in every row (1): blank" in text and "(1): constant" in text
    made = {name: {c["name"]: c for c in json.loads((out / "draft_croissants" / f"{name}.draft.json").read_text())[draft.COLUMNS]} for name in ("jobs", "packed", "packed2", "packed3")}
    assert made["jobs"] == made["packed"] == made["packed2"] == made["packed3"]
    assert made["jobs"]["exit_code"]["largest_number"] == 1.0
    assert "NOT consistent" in (out / "reports" / "jobs.txt").read_text()
    again = directory.document(spark, f"file://{folder}", str(out), skip_existing=True)
    assert again.count("SKIPPED -- already documented. 2 rows, 2 columns") == 4 and again.count("check before sharing: username") == 4


def test_a_run_goes_on_where_another_ended(spark, folder, tmp_path, monkeypatch):
    out, state = tmp_path / "out", f"file://{tmp_path}/state"
    whole, said = directory.document(spark, f"file://{folder}", str(tmp_path / "whole")), []
    written = directory._written

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(directory, "_written", killed)
    with pytest.raises(KeyboardInterrupt):
        directory.document(spark, f"file://{folder}", str(out), state=state, save_every=60)
    left = directory.State(spark, state, f"file://{folder}").outstanding()
    assert len(left) == 8 and directory.State(spark, state, "file:///elsewhere").outstanding() == []
    monkeypatch.setattr(directory, "_written", written)
    (folder / "jobs.csv").write_text("username,exit_code\nannika,0\nboris,1\ncarla,7\n")
    scanned, scan = [], directory.scanned
    monkeypatch.setattr(directory, "scanned", lambda spark, paths, *more: scanned.append(paths) or scan(spark, paths, *more))
    text = directory.document(spark, f"file://{folder}", str(out), state=state, told=said.append)
    assert [[p.rsplit("/", 1)[-1] for p in paths] for paths in scanned] == [["jobs.csv"]]
    assert any("7 files were scanned by an earlier run" in s for s in said) and said[-1].startswith("6 read, 0 skipped, 2 failed")
    assert directory.State(spark, state, f"file://{folder}").outstanding() == []
    mine = lambda t: [x for x in t.split("\n") if "jobs" not in x and "rows, 2 columns" not in x and ":" not in x]
    assert mine(text) == mine(whole) and "3 rows, 2 columns read" in text


def test_refusals(spark):
    row = {"format": 1, "path": "/a", "size": 3, "modified": 5, "separator": ",", "cap": 9, "preview": 0, "identifiers": True}
    wanted = spark.createDataFrame([row], manifest.WANTED)
    why = lambda saved, reason=None: manifest.validity(wanted, saved and spark.createDataFrame([{**row, "rows_done": 1, "counts": "g", **saved}], manifest.SCHEMA), reason).first()["refusal"]
    assert why(None) == "nothing saved" and why({"rows_done": 1}) is None and why({"rows_done": 1}, "off") == "off"
    said = [why(x) for x in ({"path": "/b"}, {"format": 7}, {"size": 4}, {"modified": 4}, {"cap": 8}, {"preview": 10}, {"rows_done": 0})]
    assert said == ["nothing saved", "saved by another version", "the file has changed", "the file has changed", "the settings have changed", "the settings have changed", "no progress saved"]


def test_one_scan_of_the_files(spark, folder):
    plan = L.value_counts(L.read_files(spark, [f"{folder}/jobs.csv"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and plan.count("Exchange") == 1


def test_command_line(spark, folder, tmp_path, capsys):
    from quern import cli

    assert cli.main(["file", str(folder / "jobs.csv"), "--json", str(tmp_path / "jobs.json"), "--quiet"]) == 0
    made = json.loads((tmp_path / "jobs.json").read_text())
    assert (made["file"]["rows"], made["file"]["columns"], [c["column_name"] for c in made["columns_to_check"]]) == (2, 2, ["username"])
    assert cli.main(["file", str(folder / "broken.csv"), "--quiet"]) == 1
    assert cli.main(["directory", str(folder), "--output", str(tmp_path / "o"), "--full", "--no-croissant"]) == 0
    said = capsys.readouterr()
    assert "8 CSV files" in said.err and "full scan" in said.out and not (tmp_path / "o" / "draft_croissants").exists()
    (tmp_path / "m.json").write_text('{"name": "x"}')
    assert cli.main(["render", str(tmp_path / "m.json"), "-o", str(tmp_path / "m.md")]) == 0 and (tmp_path / "m.md").read_text().startswith("# x")
    with pytest.raises(SystemExit):
        cli.main(["render", str(tmp_path / "m.json"), "a.md", "-o", "b.md"])
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert "quern 0" in capsys.readouterr().out
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text('{"log": "x"}\n{"log": "level=info msg=y", "_p": "F"}\n{bad\n')
    assert cli.main(["logs", str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), str(tmp_path / "gone"), "--out", str(tmp_path / "l")]) == 0
    said = capsys.readouterr().out
    assert "a.txt: 3 records, 0 fragments joined, 1 problems" in said and "all 2 files\n  records              6" in said and "gone: no such file" in said
    assert (tmp_path / "l" / "b.parsed.jsonl").is_dir()


def test_preview_ends_early(spark, folder):
    rows = L.read_csv(spark, f"{folder}/dull.csv", rows=3).collect()
    assert [r["varied"] for r in rows] == ["0", "1", "2"]
    with pytest.raises(ValueError):
        L.read_files(spark, [f"{folder}/dull.csv"], rows=0)
    with pytest.raises(ValueError, match="never closed"):
        L.read_csv(spark, f"{folder}/broken.csv")


def test_estimates(tmp_path):
    body = "v\n" + "".join(f"value{i}\n" for i in range(20_000))
    for suffix, squeeze in (("", lambda b: b), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress)):
        path = tmp_path / f"big.csv{suffix}"
        path.write_bytes(squeeze(body.encode()))
        assert abs(S.estimated_rows(str(path)) - 20_000) <= 2_000
    assert S.estimated_rows(str(tmp_path / "none.csv")) is None
    assert (S.rows_a_batch(66), S.rows_a_batch(1), S.rows_a_batch(10_000)) == (15_151, 100_000, 2_000)


def test_rows_are_counted(tmp_path):
    body = "k,v\n" + "".join(f"{i},value{i * 7919 % 100_003}\n" for i in range(60_000))
    for suffix, squeeze in (("", lambda b: b), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress)):
        path = tmp_path / f"small.csv{suffix}"
        path.write_bytes(squeeze(body.encode()))
        assert S.estimated_rows(str(path)) == 60_000
        assert S.estimated_rows(str(path), sample=1 << 10, exact=None) == 60_000
    (tmp_path / "damaged.csv.gz").write_bytes(gzip.compress(body.encode())[:2000] + b"\xff" * 2000)
    assert S.estimated_rows(str(tmp_path / "damaged.csv.gz")) is None


def test_row_estimates_at_sixty_times_the_suppliers(spark, tmp_path):
    from quern import file_queries as Q

    spark.range(60_000).selectExpr("id AS s_suppkey", "format_string('Supplier#%09d', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["suffix"]: r["estimated"] for r in Q.row_estimates(spark, str(tmp_path)).collect()} == dict.fromkeys(("", ".gz", ".bz2", ".xz"), 60_000)


def test_collisions(spark, folder):
    (folder / "jobs.csv.gz").write_bytes(b"")
    found = S.collisions(S.classified(S.listing(spark, f"file://{folder}"))).collect()
    assert [r["name"] for r in found] == ["jobs.csv.gz"]


COLUMN = {"column_name": "a", **dict.fromkeys(draft.MEASURED, 0), "most_common_values": [], "smallest_number": None, "largest_number": None}


def test_draft_is_invalid_on_purpose():
    made = draft.build({"name": "j.csv", "path": "/x/j.csv", "stem": "j", "size": 3, "rows": 2, "scope": "full scan"}, [COLUMN], None)
    assert "DO-NOT-SUBMIT" in made["conformsTo"] and all("dataType" not in f for f in made["recordSet"][0]["field"])
    assert json.dumps(made).count(draft.NOTICE) >= 3 and "license" not in made and "largest_number" not in made[draft.COLUMNS][0]
    assert draft.outcome_of(made)["check_results_unknown"] and draft.outcome_of({})["rows"] is None
    text = markdown.render(made)
    assert text == markdown.render(json.loads(json.dumps(made))) and text.startswith("# j\n") and draft.OPEN in text and text.endswith("*\n")


def test_markdown():
    meta = {
        "name": "d", "description": "about", "creator": {"name": "lab"}, "license": {"name": "CC", "url": "u"}, "citeAs": "me", "rai:hasSyntheticData": False, "rai:dataBiases": ["one", "two"],
        "recordSet": [
            {"name": "r", "field": [{"name": "f", "dataType": "sc:Text", "description": "a | b\nc"}]},
            {"name": "e", "isEnumeration": True, "data": '[{"e/code": 1}, {"e/code": 2, "e/text": "x"}]'}, {"name": "bad", "isEnumeration": True, "data": "{"},
        ],
    }
    text = markdown.render(meta)
    for part in ("- **Publisher:** lab", "**CC**", "See: u", "> me", "| `f` | Text | a \\| b c |", "| code | text |", "| 1 |  |", "- one\n- two", "Synthetic data in it: **no**", "### `bad`"):
        assert part in text, part
    assert "\n\n\n" not in text
    with pytest.raises(ValueError, match="line 1"):
        markdown.load("{")
    with pytest.raises(ValueError, match="list"):
        markdown.load("[]")
