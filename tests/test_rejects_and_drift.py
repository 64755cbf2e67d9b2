import re
from datetime import datetime

import pandas as pd
import pytest

from brackwater.operators import drift, rejects
from brackwater.shared import table

F8, T8 = ["ts", "p1", "temp", "event"], ["text", "int", "decimal", "text"]


@pytest.mark.parametrize("line,sep,want", [
    ("2024-01-05 1:02:03,5,20.5,LM", ",", None), (" 2024-01-05 01:02, 5 ,20, LM \r", ",", None), ("2024-01-05 01:02 ,5,20,LM", ",", "bad_separator"), ("01-05 01:02:03,5,20,", ",", None), ("02-29 01:02:03,5,20,", ",", None),
    ("2024-02-30 01:02:03,5,20,LM", ",", "bad_time"), ("2024-01-05 25:02,5,20,LM", ",", "bad_time"), ("01-05 1:02:03,5,20,LM", ",", "bad_time"), ("24-01-05 01:02:03,5,20,LM", ",", "bad_time"),
    ("2024-01-05 01:02:03;5,20,LM", ",", "bad_separator"), ("2024-01-05 01:02:03.5,5,20,LM", ",", "bad_separator"), ("2024-01-05 01:02:03", ",", "bad_separator"),
    ('2024-01-05 01:02:03,5,20,"LM', ",", "broken_quote"), ('2024-01-05 01:02:03,5,20,L"M"', ",", "broken_quote"), ('2024-01-05 01:02:03,5,20,"LM" x', ",", "broken_quote"),
    ('2024-01-05 01:02:03,5,20,"a, ""b"" c"', ",", None), ('2024-01-05 01:02:03,5,20, "a" ', ",", None), ("2024-01-05 01:02:03,5,20", ",", "wrong_count"), ("2024-01-05 01:02:03,5,20,LM,", ",", "wrong_count"),
    ("2024-01-05 01:02:03,5.0,20,LM", ",", "bad_value"), ("2024-01-05 01:02:03,+5,20,LM", ",", "bad_value"), ("2024-01-05 01:02:03,１,20,LM", ",", "bad_value"), ("2024-01-05 01:02:03,5,1e1,LM", ",", "bad_value"),
    ("2024-01-05 01:02:03,4096,20,LM", ",", "out_of_range"), ("2024-01-05 01:02:03,-1,20,LM", ",", "out_of_range"), ("2024-01-05 01:02:03,0,60.01,LM", ",", "out_of_range"), ("2024-01-05 01:02:03,,,", ",", None),
    ("2024-01-05 24:00:00,5,20,LM", ",", "bad_time"), ("2024-01-05 24:00,5,20,LM", ",", "bad_time"), ("2024-01-05 01:02:03,5,5.,LM", ",", "bad_value"), ("2024-01-05 01:02:03,5,-.5,LM", ",", "bad_value"),
    ('2024-01-05 01:02:03,5,20,"a" ,', ",", "wrong_count"), ('2024-01-05 01:02:03,5,20,""', ",", None), ('2024-01-05 01:02:03,"5","20","x,y"', ",", None), ('2024-01-05 01:02:03,"5x","20","x,y"', ",", "bad_value"), ('2024-01-05 01:02:03,5a"b,"c', ",", "broken_quote"),
    ("2024-01-05 01:02:03\t5\t20\t", "\t", None), ("2024-01-05 01:02:03\t\t\t\r", "\t", None), ("2024-01-05 01:02:03\t5\t20", "\t", "wrong_count"), ('2024-01-05 01:02:03;5;20;"a;b"', ";", None),
])
def test_line_rule(line, sep, want):
    assert rejects.reason_of(line, sep, F8, T8) == want
    # The reader gives the same, alone and between other lines.
    good = "2024-01-05 01:02:03,5,20,LM".replace(",", sep)
    for lines in ([line], [good, line, line, good]):
        pdf = pd.DataFrame({"line_id": range(len(lines)), "file_id": "f", "line_no": 1, "line": lines, "sep": sep, "fields": "\x01".join(F8), "types": "\x01".join(T8)})
        got = pd.concat(rejects._judge(False, iter([pdf]))).sort_values("line_id")
        assert list(zip(got["line_id"], got["reason"], strict=True)) == [(i, want) for i, x in enumerate(lines) if x == line and want]
        whole = pd.concat(rejects._judge(True, iter([pdf]))).sort_values("line_id")
        assert list(whole["line_id"]) == list(range(len(lines))) and list(whole["reason"].isna()) == [x != line or not want for x in lines]


FILES = "file_id string, source_id string, subject_id string, device_id string, uploaded_at timestamp_ntz, sep string, headers string, field_types string"
ALIASES = [("time", "ts"), ("ts", "ts"), ("p1", "p1"), ("fsr1", "p1"), ("temp", "temp"), ("t", "temp"), ("evt", "event"), ("dev", "device_id"), ("bat", "battery")]


@pytest.fixture(scope="module")
def world(spark):
    day = lambda i: datetime(2024, 1, i)
    files = [("f1", "s", "u", "d", day(1), ",", '﻿time,P1," temp ",evt', "text,int,int,text"), ("f2", "s", "u", "d", day(2), ",", None, None), ("f1", "s", "u", "d", day(5), ",", '﻿time,P1," temp ",evt', "text,int,int,text"),
             ("f3", "s", "u", "d", day(3), ",", "time,temp,fsr1,bat", "text,decimal,int,int"), ("g1", "z", "u", "d", None, ";", None, None), ("h1", None, None, None, day(1), ",", "ts,p1", "text,int"), ("h2", None, None, None, day(9), ",", "ts,p1", "text,int")]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(ALIASES, "alias string, field string")


LINES = "line_id long, file_id string, line_no int, line string, sep string"


def test_changes(world, rows_of):
    got = rows_of(drift.changes(*world))
    assert got == sorted([("f3", "added", "battery"), ("f3", "removed", "event"), ("f3", "renamed", "p1"), ("f3", "retyped", "temp")])


def test_found_and_table(spark, world, rows_of):
    lines = [(1, "f1", 1, "time,P1,temp,evt", "x"), (2, "f1", 2, '2024-01-05 01:02:03,5,20,"a, b"', "x"), (3, "f2", 1, "2024-01-05 01:02:03,5,999,LM", "x"), (4, "f2", 2, "2024-01-05 01:02:03,5,x,LM", "x"), (5, "f3", 1, "2024-01-05 01:02:03,20.5,7,80", "x"),
             (6, "g1", 1, "2024-01-05 01:02:03,1", "x"), (7, "gone", 1, "2024-01-05 01:02:03,1", "x"), (8, None, 1, "2024-01-05 01:02:03,1", "x"), (9, "f1", 3, None, "x"), (10, "f1", 4, "", "x"), (11, "f1", 5, "2024-01-05 01:02:03,1,2," + "é" * 40_000, "x"), (12, "h2", 1, "2024-01-05 01:02:03,9", "x")]
    df = spark.createDataFrame(lines, LINES)
    assert rows_of(rejects.found(df, *world)) == [(3, "out_of_range"), (4, "bad_value")]
    t = {r["line_id"]: r for r in drift.ingest(df, *world).collect()}
    assert t[2]["event"] == "a, b" and t[2]["p1"] == 5 and t[2]["rescued"] is None
    assert t[4]["temp"] is None and t[4]["rescued"] == '{"temp":"x"}'
    assert t[5]["p1"] == 7 and t[5]["temp"] == 20.5 and t[5]["rescued"] == '{"battery":"80"}'
    assert "line" in t[6]["rescued"] and "line" in t[7]["rescued"] and 9 not in t
    back = {r["line_id"]: r for r in drift.promote(drift.ingest(df, *world), {"battery": "int"}).collect()}
    assert back[5]["battery"] == 80 and back[5]["rescued"] is None and back[4]["rescued"] == '{"temp":"x"}'
    bad_without_id = spark.createDataFrame([(None, "f1", 9, "2024-01-05 01:02:03,x,2,LM", "x")], LINES)
    loaded = {r["line_id"]: r for r in rejects.loaded(df.unionByName(bad_without_id), *world).collect()}
    assert set(loaded) == set(t) - {3, 4}
    assert all(loaded[i].asDict() == t[i].asDict() for i in loaded)
    assert rejects.found(spark.createDataFrame([], LINES), *world).count() == 0


def test_reader_and_rule_agree(spark, sf, rows_of):
    lines, files, aliases = (table(spark, sf, n) for n in ("raw_lines", "log_files", "field_aliases"))
    layouts = {r[0]: r for r in rejects.layouts(files, aliases).collect()}
    want = []
    for r in lines.collect():
        if r["line"] and re.match(drift.DATA_LINE.replace(r"\p{Z}", "　 "), r["line"]) and r["file_id"] in layouts:
            _, sep, f, t = layouts[r["file_id"]]
            if why := rejects.reason_of(r["line"], sep, f.split("\x01"), t.split("\x01")):
                want.append((r["line_id"], why))
    assert rows_of(rejects.found(lines, files, aliases)) == sorted(want, key=lambda r: [(False, str(x)) for x in r])
