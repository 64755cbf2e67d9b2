import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brackwater.operators import grid, sessions

WINDOWS = "window_id long, subject_id string, device_id string, t0 long, prov string, session_id string"


def test_sessions_by_hand(spark, rows_of):
    day = 86_400
    data = [
        (1, "a", "x", 10, None, "s"), (2, "a", "x", 10, None, "s"), (3, "a", "x", 1_810, None, None), (4, "a", "x", 3_611, None, None),
        (5, "a", None, 7, "bad", None), (6, None, None, None, "x|1970-01-01|1970-01-01 00:00:09", None), (7, "a", "x", None, None, None), (8, "a", "x", None, "x|n|1970-02-30 00:00:00", None),
        *[(100 + i, "b", "x", day - 3_000 + i * 1_000, None, None) for i in range(200)],  # over several days without a gap
    ]
    got = rows_of(sessions.found(spark.createDataFrame(data, WINDOWS)))
    assert got == sorted([("a", "x", 10, 1_810, 2), ("a", "x", 3_611, 3_611, 1), ("a", None, 7, 7, 1), (None, None, 9, 9, 1), ("b", "x", day - 3_000, day - 3_000 + 199_000, 200)],
                         key=lambda r: [(x is None, str(x)) for x in r])
    assert sessions.found(spark.createDataFrame([], WINDOWS)).count() == 0


def test_sessions_brute_force_and_chunks(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(0, 400_000)) for _ in range(700)]
    df = spark.createDataFrame(data, "k string, s long").withColumn("start_s", F.lit(1)).withColumn("_c", F.lit("clash"))
    want = set()
    for k in "ab":
        t = sorted({s for x, s in data if x == k})
        a = b = t[0]
        n = 1
        for s in [*t[1:], None]:
            if s is not None and s - b <= 600:
                b, n = s, n + 1
                continue
            want.add((k, a, b, b - a, n))
            if s is not None:
                a = b = s
                n = 1
    for chunk in (100, 5_000, 86_400):
        assert {tuple(r) for r in sessions.sessions(df, ["k"], "s", 600, chunk).collect()} == want


SENSOR = "subject_id string, device_id string, spec_code string, ts timestamp_ntz, p1 int, p2 int, p3 int, p4 int, p5 int, p6 int, temp double, humid double, k int"


def at(s):
    return datetime(1970, 1, 1) + timedelta(seconds=s)


def row(s, k="a", spec="w", temp=20.0, p1=None):
    return (k, "x", spec, None if s is None else at(s), p1, None, None, None, None, None, temp, None, 7)


def test_grid(spark, rows_of):
    specs = spark.createDataFrame([("w", 10, 30), ("w", 10, 30), ("n", 10, None), (None, 5, 5)], "spec_code string, bin_s int, max_gap_s int")
    data = [row(3), row(3), row(9), row(25), row(71), row(1_871), row(3_680), row(None), row(500, temp=None), row(600, temp=float("nan")), row(700, spec="?"), row(800, spec=None),
            row(86_399.5, "b"), row(86_425, "b"), row(0, "c", "n"), row(25, "c", "n")]
    df = spark.createDataFrame(data, SENSOR)
    got = rows_of(grid.found(df, specs))
    assert got == sorted([("a", "x", 10, 20, "filled"), ("a", "x", 30, 70, "missing"), ("a", "x", 80, 1_870, "missing"), ("b", "x", 86_400, 86_420, "filled"), ("c", "x", 10, 20, "missing")],
                         key=lambda r: [(x is None, str(x)) for x in r])
    whole = grid.regular(df, specs)
    b = [(r["bin_start_s"], r["state"], r["temp"]) for r in whole.where("subject_id = 'b'").orderBy("bin_start_s").collect()]
    assert b == [(86_390, "observed", 20.0), (86_400, "filled", 20.0), (86_410, "filled", 20.0), (86_420, "observed", 20.0)]
    assert whole.where("state = 'missing' and temp is not null").count() == 0
    assert grid.found(spark.createDataFrame([], SENSOR), specs).count() == 0
    every = grid.occupied_bins(df, specs, values=False)
    for shard in (10, 1_000):
        assert grid.with_next(every, shard).where("next_k is not null").count() == grid.with_next(every).where("next_k is not null").count()
