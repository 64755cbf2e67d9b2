"""The cluster bootstrap over many nights: its sums, and that the table of draws is never formed."""

import duckdb
import pytest

import __spark_entry__ as entry
from brackwater.operators import stats

NIGHTS = 700


@pytest.fixture(scope="module")
def nights(spark, tmp_path_factory):
    """Three subjects with NIGHTS nights of three readings."""
    d = str(tmp_path_factory.mktemp("nights"))
    duckdb.sql(f"copy (select k * 100 + k % 7 * 13 + x * 2 as event_id from range({3 * NIGHTS}) t(k), range(3) u(x)) to '{d}/events.parquet'")
    return d


def most_rows(df) -> int:
    """Rows out of the largest step of a query that has run."""

    def steps(node):
        yield node
        name = node.getClass().getSimpleName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        for child in below or [node.children().apply(i) for i in range(node.children().size())]:
            yield from steps(child)

    metrics = [x.metrics().get("numOutputRows") for x in steps(df._jdf.queryExecution().executedPlan())]
    return max(m.get().value() for m in metrics if m.isDefined())


def plain(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["N05_correlation_bootstrap_whole", "O02_interpretation_whole", "N02_resampled_errors_whole", "N06_eta_interval"])
def test_many_nights(spark, nights, name):
    con = duckdb.connect()
    con.execute(f"create view events as from '{nights}/events.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, nights).select(*want.columns)
    assert plain(tuple(r) for r in df.collect()) == plain(want.fetchall())
    assert most_rows(df) < NIGHTS * 2_000  # the draws of one subject


@pytest.mark.parametrize("draws_a_group", [1, 50, 1 << 23])
def test_sums_over_draws(spark, draws_a_group):
    """Runs of any length give the sums over the joined draws; nights without a key, a null key and a key never drawn."""
    cells = [("A", 9, i, k, 1 + i % 2, 10 * i - v) for i in range(1, 10) for v, k in enumerate(["x", "y", None]) if i % 4 != v] + [("B", 1, 1, "x", 2, -5), ("C", 40, 1, "rare", 1, 2**40)]
    df = spark.createDataFrame(cells, "subject_id string, nights int, ordinal int, kind string, n long, v long")
    drawn = stats.draws(df.select("subject_id", df["nights"].cast("long").alias("n")).distinct(), 30)
    want = drawn.join(df, ["subject_id", "ordinal"]).selectExpr("subject_id", "kind", "resample", "times * n as n", "times * v as v").groupBy("subject_id", "kind", "resample").sum("n", "v").collect()
    got = stats.resampled_sums(df, "kind", ["n", "v"], 30, draws_a_group)
    assert got.columns == ["subject_id", "kind", "resample", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert 0 < sum(r["kind"] == "rare" for r in want) < 30


def test_errors_read_once(spark, tmp_path):
    """Many readings a night: no step of N02 has more rows than the readings themselves; nights without valid readings and a null id."""
    readings = 20_000
    duckdb.sql(f"copy (select x as event_id from range({readings}) t(x) where x // 300 <> 5 or x % 53 = 0 union all select null) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    want = con.sql(entry.oracle_sql()["N02_resampled_errors_whole"])
    df = entry.queries()["N02_resampled_errors_whole"](spark, str(tmp_path)).select(*want.columns)
    assert plain(tuple(r) for r in df.collect()) == plain(want.fetchall())
    assert most_rows(df) <= readings


@pytest.mark.parametrize("nights", [stats.PERIOD, stats.PERIOD + 1, 20_000])
def test_draws_repeat_after_the_period(spark, nights):
    drawn = stats.draws(spark.createDataFrame([("A", nights)], "subject_id string, n long"), 5)
    cells = spark.range(1, nights + 1).selectExpr("'A' as subject_id", f"{nights} as nights", "id as ordinal", "'x' as kind", "1L as n", "id * id as v")
    want = drawn.groupBy("resample").agg({"times": "sum"}).join(drawn.selectExpr("resample", "times * ordinal * ordinal as v").groupBy("resample").sum("v"), "resample")
    assert sorted(tuple(r) for r in stats.resampled_sums(cells, "kind", ["n", "v"], 5).select("resample", "n", "v").collect()) == sorted(tuple(r) for r in want.collect())


def test_runs_are_spread(spark):
    """Runs of few rows and many draws are not put together in one task."""
    cells = spark.createDataFrame([("A", 9, i, "x", 1) for i in range(1, 10)], "subject_id string, nights int, ordinal int, kind string, n long")
    assert stats.resampled_sums(cells, "kind", ["n"], 30, 9).rdd.getNumPartitions() > 1
