import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackwater.operators import joins
from brackwater.operators.ordered import islands, longest_true, neighbour, running_sum
from brackwater.shared import floor_div, sharded_previous


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), t, i, rng.choice([None, 1, 2, 3]), t // 50) for i, t in enumerate(sorted(rng.randrange(600) for _ in range(300)))]
    return pd.DataFrame(rows, columns=["k", "t", "i", "v", "shard"]).astype({"v": "Int64"})


SCHEMA = "k string, t long, i long, v long, shard long"


def frame(spark, pdf):
    return spark.createDataFrame([tuple(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in r) for r in pdf.itertuples(index=False)], SCHEMA)


def test_neighbour_sum_islands(spark, series):
    df = frame(spark, series)
    want_prev, want_sum, want_isl = {}, {}, {}
    for _, g in series.fillna({"k": "-"}).groupby("k"):
        total = isl = 0
        before = None
        for r in g.itertuples():
            want_prev[r.i] = before
            total += r.i
            want_sum[r.i] = total
            isl += before is None or r.t - before > 3
            want_isl[r.i] = isl
            before = r.t
    got = {r["i"]: r["p"] and r["p"]["t"] for r in neighbour(df, ["k"], ["t", "i"], "shard", ["t"], "p").collect()}
    assert got == want_prev
    assert {r["i"]: r["s"] for r in running_sum(df, ["k"], ["t", "i"], "shard", "i", "s").collect()} == want_sum
    assert {r["i"]: r["n"] for r in islands(df, ["k"], ["t", "i"], "shard", ["t"], lambda p: F.col("t") - p("t") > 3, "n").collect()} == want_isl


def test_previous_non_null_both_ways(spark, series):
    df = frame(spark, series)
    want, after = {}, {}
    for _, g in series.fillna({"k": "-"}).groupby("k"):
        seen = None
        for r in g.itertuples():
            want[r.i] = seen
            seen = seen if pd.isna(r.v) else int(r.v)
        seen = None
        for r in list(g.itertuples())[::-1]:
            after[r.i] = seen
            seen = seen if pd.isna(r.v) else int(r.v)
    assert {r["i"]: r["o"] for r in sharded_previous(df, ["k"], ["t", "i"], "shard", "v", "o").collect()} == want
    assert {r["i"]: r["o"] for r in sharded_previous(df, ["k"], ["t", "i"], "shard", "v", "o", ahead=True).collect()} == after


def test_longest_true_and_floor(spark):
    df = spark.createDataFrame([("a", i, i // 4, f) for i, f in enumerate([True, True, None, True, True, True, True, False])], "k string, t long, shard long, f boolean")
    assert [tuple(r) for r in longest_true(df, ["k"], ["t"], "shard", "f").collect()] == [("a", 4)]
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*[floor_div(F.lit(x), 5) for x in (-6, -5, -1, 0, 4, 5)]))).collect()] == [-2, -1, -1, 0, 0, 1]


def test_nearest_and_asof(spark):
    rng = random.Random(2)
    a = [("x", rng.randrange(200_000), i) for i in range(80)]
    b = [("x", rng.randrange(200_000), i) for i in range(150)] + [("x", a[0][1] - 5, 900), ("x", a[0][1] + 5, 901)]
    da, db = (spark.createDataFrame(x, "k string, t long, i long") for x in (a, b))
    got = {r["i"]: r["near"] and r["near"]["t"] for r in joins.nearest(da, db, ["k"], "t", ["i"], 300, "i").collect()}
    past = {r["i"]: r["event"] and r["event"]["t"] for r in joins.asof(da, db, ["k"], "t", ["i"], 2_000, "i").collect()}
    for _, t, i in a:
        best = min(b, key=lambda r: (abs(r[1] - t), r[1]))[1]
        assert got[i] == (best if abs(best - t) <= 300 else None)
        old = max((r[1] for r in b if r[1] <= t), default=None)
        assert past[i] == (old if old is not None and t - old <= 2_000 else None)


def test_intervals(spark):
    rng = random.Random(3)
    iv = [("x", s, s + rng.randrange(1, 40_000)) for s in (rng.randrange(400_000) for _ in range(40))]
    seconds = set()
    for _, lo, hi in iv:
        seconds.update(range(lo, hi))
    df = spark.createDataFrame([*iv, ("x", 5, 5)], "k string, lo long, hi long")
    assert joins.merged_length(df, ["k"], "lo", "hi").first()["seconds"] == len(seconds)
