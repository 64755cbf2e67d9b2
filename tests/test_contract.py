import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FAST = ["p4_found", "p6_found", "p7_found", "C04_values_and_schema", "C13_calendar", "D02_pressure_quality", "E07_overlapping_files", "E09_aligned_runs", "E14_copy_roots",
        "F01_nearest", "F02_asof_event", "F15_coverage_overlap", "G08_dominant_step", "G15_binned_trend", "H01_bridged_sessions", "H07_constant_frame", "I02_windows", "I11_history_features",
        "J02_spearman", "J04_shift_whole_numbers", "J08_cliffs_delta", "K03_budgets", "L03_offset", "M05_strata", "N02_resampled_errors", "P06_table_difference", "R01_time_order"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAST


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.8g}")
    if isinstance(v, bool | int):
        return int(v)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as from '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, views, name):
    df = entry.queries()[name](spark, sf)
    want = views.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
