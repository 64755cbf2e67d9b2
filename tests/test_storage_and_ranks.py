import pytest
from pyspark.sql import functions as F

from brackwater import shared
from brackwater.functions import scalars
from brackwater.operators import compare, drift, fits, rejects
from brackwater.operators.ordered import global_rank
from brackwater.sources import logs, sinks


def test_global_rank(spark):
    df = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("x")).repartition(5)
    rows = global_rank(df, ["x"], "place").collect()
    assert all(r["x"] == r["place"] for r in rows) and len(rows) == 1_000
    assert global_rank(df.limit(0), ["x"], "place").count() == 0


def test_lines_to_files_and_back(spark, tmp_path):
    lines = spark.createDataFrame([("a", 2, "zwei"), ("a", 1, "eins"), ("b", 1, ""), ("b", 2, "한글 é")], "k string, n int, t string")
    sinks.write_lines(lines, str(tmp_path / "raw"), sinks.Guard([]), "k", ["n"], "t")
    got = {(r["path"].split("key=")[1][0], r["line_no"], r["line"]) for r in logs.read_lines(spark, str(tmp_path / "raw")).collect()}
    assert got == {("a", 1, "eins"), ("a", 2, "zwei"), ("b", 1, ""), ("b", 2, "한글 é")}
    paths = spark.createDataFrame([("A/x/../b",), ("a//./b",), ("x/y/../../a/b",)], "p string")
    assert {r[0] for r in paths.select(sinks.resolved(F.col("p"))).collect()} == {"a/b"}


def test_lookups_and_settings(spark):
    cells = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", None)], "k string, v string")
    assert {tuple(r) for r in compare.unique_cells(cells, ["k"], "v").collect()} == {("a", "1", "one"), ("b", None, "many"), ("c", None, "none")}
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("z", 4)], "k string, n int")
    assert {tuple(r) for r in sinks.setting_differences(a, b, "k", ["n"]).collect()} == {("y", "n", "2", "3"), ("z", "n", None, "4")}
    printed = spark.createDataFrame([("x", 1.004), ("y", 2.0), ("w", 1.0)], "k string, printed double")
    assert {r["k"] for r in compare.untraceable(printed, a.select("k", F.col("n").cast("double").alias("cell")), ["k"], 2).collect()} == {"w"}
    with pytest.raises(ValueError, match="not broadcast"):
        fits.predict(a, b"x" * 100, lambda m, p: p["n"], ["n"], most_bytes=10)


def test_repeated_fields_are_rescued(spark):
    files = spark.createDataFrame([("f", "s", "u", "d", None, ",", "ts,p1,p1,bat", "text,int,int,int")], "file_id string, source_id string, subject_id string, device_id string, uploaded_at timestamp_ntz, sep string, headers string, field_types string")
    aliases = spark.createDataFrame([("bat", "battery")], "alias string, field string")
    lines = spark.createDataFrame([(1, "f", 1, "2024-01-05 01:02:03,5,6,80")], "line_id long, file_id string, line_no int, line string")
    want = '{"p1_2":"6","battery":"80"}'
    assert drift.ingest(lines, files, aliases).first()["rescued"] == want and rejects.loaded(lines, files, aliases).first()["rescued"] == want
    assert drift.promoted(lines, files, aliases).first()["battery"] == 80


def test_scalars_as_published(spark):
    kinds = ["", "{", '",', ",,,", '"2024-01-01_00-00-00": {', '"logs": {', "[NVS] x", "Rebooting...", "A12   : 0x1", '"csvData": "2024-01', "2024-01-05 1:02:03,5", "hello"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(kinds)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(scalars.line_kind(F.col("t"))).collect()]
    assert got == ["blank", "json_struct", "json_struct", "empty_csv_row", "json_chunk_key", "json_root_key", "nvs_log", "crash_dump", "crash_dump", "malformed_data", "data", "device_log"]
    gaps = spark.createDataFrame([(-1, "overlap"), (0, "0-10s"), (10, "0-10s"), (11, "10-60s"), (7_200, "1800-7200s"), (7_201, ">7200s")], "d int, want string")
    assert all(r[0] == r[1] for r in gaps.select(scalars.gap_bin(F.col("d")), "want").collect())
    times = spark.createDataFrame([(0, "D0001 00:00:00"), (90_061, "D0002 01:01:01")], "s long, want string")
    assert all(r[0] == r[1] and r[2] == r[3] for r in times.select(scalars.relative(F.col("s")), "want", scalars.relative_seconds(F.col("want")), "s").collect())
    days = spark.createDataFrame([("2024-12-01", "2024-winter"), ("2025-02-28", "2024-winter"), ("2025-03-01", "2025-spring"), ("2025-11-30", "2025-autumn")], "d string, want string")
    assert all(r[0] == r[1] for r in days.select(scalars.season(F.col("d").cast("date")), "want").collect())


def test_tables_are_dropped(spark):
    df = shared.written(spark.range(3), "drop")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert sinks.Store(spark).exists(path) and shared.drop_tables() >= 1 and not sinks.Store(spark).exists(path)
