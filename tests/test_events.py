"""Movement events, coincidence inside coverage, and trajectories over valid readings."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brackwater.operators import joins, series


def test_times_outside_the_coverage_are_no_misses(spark):
    times = spark.createDataFrame([("b", 10), ("b", 50), ("b", 500), ("b", -5)], "k string, t long")
    events = spark.createDataFrame([("b", 12)], "k string, t long")
    coverage = spark.createDataFrame([("b", 0, 60)], "k string, lo long, hi long")
    got = {(r["t"], r["hit"]) for r in joins.coincidence(times, events, coverage, ["k"], "t", 3).collect()}
    assert got == {(10, 1), (50, 0)}


def test_last_row_covers_last_s(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0), ("a", 10, 1, 0), ("a", 200, 2, 0)], "k string, t long, i long, day long")
    got = {tuple(r) for r in joins.covered(rows, ["k"], ["t", "i"], "t", "day", 60, last_s=1).collect()}
    assert got == {("a", 0, 70), ("a", 200, 201)}


def test_movements_need_a_close_row_before(spark):
    rows = [("a", t, i, 0, 10 + (400 if i == 10 else 0)) for i, t in enumerate(range(0, 80, 4))] + [("a", 1_000, 99, 0, 9_000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, day long, p long")
    got = sorted(r["i"] for r in series.movements(df, ["k"], ["t", "i"], "day", "t", ["p"], 0.95).collect())
    assert got == [10, 11]


def test_adjacent_rows_only(spark):
    t = spark.createDataFrame([("a", 10), ("a", 99)], "k string, t long")
    o = spark.createDataFrame([("a", 8, 1, 1), ("a", 10, 2, 2), ("a", 10, 3, 3), ("a", 12, 4, 4)], "k string, t long, i long, v long")
    got = {r["t"]: (r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in joins.adjacent(t, o, ["k"], "t", ["v"], "i").collect()}
    assert got == {10: (1, 2), 99: (4, None)}


@pytest.mark.parametrize("name", ["F06_event_coincidence", "F07_covered_lag_scan", "F08_valid_trajectory"])
def test_whole_forms_like_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view events as from '{sf}/events.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, sf).select(*[F.col(c) for c in want.columns])
    assert {tuple(r) for r in df.collect()} == set(want.fetchall())
