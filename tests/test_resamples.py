"""The cluster bootstrap with the 2000 draws of the reference."""

import duckdb
import pytest

import __spark_entry__ as entry


def plain(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["N01_draws_whole", "N04_paired_bootstrap_whole", "N06_eta_interval", "O02_interpretation_whole"])
def test_whole_draws_like_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view events as from '{sf}/events.parquet'")
    sql = entry.oracle_sql()[name]
    assert "generate_series(0, 1999)" in sql
    want = con.sql(sql)
    df = entry.queries()[name](spark, sf).select(*want.columns)
    assert plain(tuple(r) for r in df.collect()) == plain(want.fetchall())


def test_n01_has_every_resample(spark, sf):
    assert entry.queries()["N01_draws_whole"](spark, sf).select("resample").distinct().count() == 2_000
