"""Measures, values, identifiers, and that partitions change nothing."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import profile as P

EXAMPLE = [("alpha", "red", "10", "", "CONST"), ("bravo", "red", "20", "", "CONST"), ("charlie", "blue", "30", "x", "CONST"), ("delta", "red", "NA", "", "CONST"), ("echo", "", "-5", "", "CONST")]
NAMES = ["name", "category", "amount", "mostly_empty", "always_same"]


def profiled(spark, rows, names, cap=1000):
    freq = P.frequencies(P.cells(P.as_text(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))))
    return {r["column_name"]: r for r in P.profile(freq, cap=cap).collect()}, freq


def test_example(spark):
    got, freq = profiled(spark, EXAMPLE, NAMES)
    assert [got[n]["position"] for n in NAMES] == [0, 1, 2, 3, 4]
    category, amount, empty, same = (got[n] for n in NAMES[1:])
    assert (category["empty_count"], category["distinct_count"], category["top_count"]) == (1, 2, 3)
    assert (amount["empty_count"], amount["null_like_text_count"], amount["number_count"], amount["not_a_number_count"]) == (0, 1, 4, 1)
    assert (amount["smallest_number"], amount["largest_number"]) == (-5.0, 30.0)
    assert (got["name"]["shortest_value_length"], got["name"]["longest_value_length"]) == (4, 7)
    assert empty["empty_count"] == 4 and empty["single_value_share"] == 0.2 and not empty["is_all_empty"] and not empty["holds_one_value"]
    assert same["single_value_share"] == 1.0 and same["holds_one_value"]
    top = {(r["column_name"], r["rank"]): (r["value"], r["n"]) for r in P.top_values(freq).collect()}
    assert top["category", 1] == ("red", 3) and top["name", 1] == ("alpha", 1)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_partitions_change_nothing(spark, parts):
    rows = [(f"v{i % 37}", "" if i % 5 else str(i)) for i in range(500)]
    frame = spark.createDataFrame(rows, "a string, b string")
    whole = P.profile(P.frequencies(P.cells(P.as_text(frame)))).orderBy("position").collect()
    assert P.profile(P.frequencies(P.cells(P.as_text(frame.repartition(parts))))).orderBy("position").collect() == whole


def test_floor_of_distinct_values(spark):
    got, freq = profiled(spark, [("same",)] * 10 + [("a",), ("b",), ("c",)], ["v"], cap=1)
    assert got["v"]["distinct_count"] == 1 and got["v"]["distinct_count_is_at_least"] and got["v"]["top_count"] == 10
    (c,) = P.coverage(freq, k=1).collect()
    assert c["coverage"] == pytest.approx(10 / 13)


@pytest.mark.parametrize(("rows", "constant"), [([("x",)] * 199 + [("y",)], True), ([("x",)] * 195 + [("y",)] * 5, False), ([("",)] * 50 + [("same",)] * 50, False), ([("",)] * 4, False)])
def test_one_value(spark, rows, constant):
    got, _ = profiled(spark, rows, ["v"])
    assert got["v"]["holds_one_value"] == constant


def test_no_values_and_no_rows(spark):
    got, _ = profiled(spark, [("",), ("",)], ["a"])
    a = got["a"]
    assert (a["shortest_value_length"], a["distinct_count"], a["is_all_empty"], a["smallest_number"]) == (None, 0, True, None)
    assert profiled(spark, [], ["a"])[0] == {}


NUMBERS = {" 5": 5.0, "5 ": 5.0, "\t7": 7.0, "+5": 5.0, "5.": 5.0, ".5": 0.5, "1E5": 1e5, "-2.5e-3": -0.0025} | dict.fromkeys(
    ["1d", "1f", "1D", "0x10", "1_000", "1,000", "True", "5e", "nan", "inf", "-inf", "Infinity", "NaN", "1e400", "１", "٣", "", "."]
)


def test_numbers(spark):
    frame = spark.createDataFrame([(k,) for k in NUMBERS], "v string")
    assert {r["v"]: r["n"] for r in frame.select("v", T.number(F.col("v")).alias("n")).collect()} == NUMBERS


@pytest.mark.parametrize(
    ("name", "values", "verdict"),
    [
        ("username", ["annika", "boris"], "NOT consistent"), ("username_id", ["1", "76", "30861277613258"], "all digits"), ("username_id", ["1", "2", "x"], "NOT consistent"), ("username", ["", ""], None),
        ("script", ["/home/c/run.py"], "paths"), ("notes", ["see /home/x for details"], None), ("runtime_seconds", ["1", "2"], None),
    ],
)
def test_concerns(spark, name, values, verdict):
    _, freq = profiled(spark, [(v,) for v in values], [name])
    found = P.concerns(P.profile(freq)).collect()
    assert [verdict in r["verdict"] for r in found] == ([True] if verdict else [])
    if verdict:
        assert found[0]["values_seen"] == len(values)


def test_digits_of_all_scripts(spark):
    frame = spark.createDataFrame([("٣4",), ("²",), ("x1",), ("-1",)], "v string")
    assert [r[0] for r in frame.select(T.is_all_digits(F.col("v"))).collect()] == [True, True, False, False]


def test_formats(spark):
    (r,) = spark.range(1).select(
        T.bytes_text(F.lit(27_787_264)).alias("a"), T.bytes_text(F.lit(5)).alias("b"), T.seconds_text(F.lit(45)).alias("c"), T.seconds_text(F.lit(192)).alias("d"), T.seconds_text(F.lit(3840)).alias("e"),
        T.cut_end(F.lit("abcdef"), 4).alias("f"), T.cut_start(F.lit("abcdefgh"), 6).alias("g"), T.table_cell(F.lit(" a\n b|c ")).alias("h"), T.short_type(F.lit("sc:Text")).alias("i"),
    ).collect()
    assert tuple(r) == ("26.5 MB", "5.0 B", "45s", "3m12s", "1h04m", "abc…", "...fgh", "a b\\|c", "Text")


def test_pairs_in_messages(spark):
    messages = ["/api: save called | userName=a@b | ModelId=g|x=1|x=2| two words=3", "no bars a=b", "bars | only", "event=1 | rest"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in messages], "m string").select(T.message_pairs(F.col("m"))).collect()]
    assert got[0] == {"log.userName": "a@b", "log.ModelId": "g", "log.x": "1", "log.event": "/api: save called | two words=3"}
    assert got[1] == {} and got[2] == {} and got[3] == {"log.event": "rest"}
