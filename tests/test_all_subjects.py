"""Queries over one subject have a form over all of them."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["D11_heater_events_all", "A09_scan_by_subject"])
def test_every_subject_comes_out(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view sensor_rows as from '{sf}/sensor_rows.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = [tuple(r) for r in entry.queries()[name](spark, sf).select(*want.columns).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
    assert len({r[0] for r in got}) == con.sql("select count(distinct subject_id) from sensor_rows").fetchall()[0][0] > 1
