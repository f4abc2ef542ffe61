"""Streams that end and go on."""

from quern.streaming import fragments, profile


def test_a_profile_goes_on_with_its_state(spark, tmp_path):
    def put(n, first):
        spark.createDataFrame([(f"v{k % 3}", k) for k in range(first, first + n)], "a string, b int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        rows = spark.readStream.schema("a string, b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        profile.run(rows, ["a"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r["value"]: r["n"] for r in profile.frequencies(spark, f"{tmp_path}/out").collect()}

    put(6, 0)
    assert run() == {"v0": 2, "v1": 2, "v2": 2}
    put(2, 6)
    assert run() == {"v0": 3, "v1": 3, "v2": 2} == run()


def test_fragments_wait_for_the_next_run(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(rows, "source string, line long, part string, log string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        rows = spark.readStream.schema("source string, line long, part string, log string").parquet(f"{tmp_path}/in")
        made = fragments.join(rows, patience=None).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        made.trigger(availableNow=True).start().awaitTermination()
        return sorted((r["line"], r["log"], r["partials"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put(("s", 1, "P", "a"), ("s", 2, "P", "b"), ("t", 3, "F", "x"))
    assert run() == [(3, "x", 0)]
    put(("s", 4, "F", "c"))
    assert run() == [(1, "abc", 2), (3, "x", 0)]
