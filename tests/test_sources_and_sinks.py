import pytest

from brackwater.sources import logs, sinks


def test_decoding_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes('﻿"2024-01-01_00-00-00": {\r\n2024-01-01 1:00,1'.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes("온도".encode("cp949"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfd\x81")
    rows = {(r["path"].split("/")[-1], r["line_no"]): r for r in logs.read_lines(spark, str(tmp_path)).collect()}
    assert rows["a.txt", 2]["chunk_key"] == "2024-01-01_00-00-00" and rows["a.txt", 1]["has_bom"] and rows["a.txt", 1]["encoding"] == "utf-8-sig"
    assert rows["b.txt", 1]["line"] == "온도" and rows["b.txt", 1]["encoding"] == "cp949" and rows["c.txt", 1]["encoding"] == "utf-8-replace"
    assert logs.listing(spark, str(tmp_path)).count() == 3
    assert logs.normalised_digest(spark, str(tmp_path)).count() == 3


def test_longest_prefix(spark):
    files = spark.createDataFrame([("a/b/x",), ("a/y",), ("z/q",)], "p string")
    prefixes = spark.createDataFrame([("a/", "one"), ("a/b/", "two")], "pre string, src string")
    assert {tuple(r) for r in logs.resolve_sources(files, prefixes, "p", "pre", "src").collect()} == {("a/b/x", "two"), ("a/y", "one")}


def test_guard_ledger_and_tables(spark, tmp_path):
    raw, out = tmp_path / "Raw", tmp_path / "out"
    raw.mkdir()
    out.mkdir()
    guard = sinks.Guard([str(raw)])
    with pytest.raises(PermissionError):
        guard.check(str(out / ".." / "Raw" / "x.csv"))
    df = spark.createDataFrame([(2, "b"), (1, None)], "a int, b string")
    digest = sinks.write_csv(df, str(out / "t.csv"), guard, ["a", "b"])
    assert (out / "t.csv").read_text() == "a,b\n1,\n2,b\n" and digest == sinks.write_csv(df, str(out / "t.csv"), guard, ["a", "b"])
    with pytest.raises(ValueError, match="columns"):
        sinks.write_csv(df, str(out / "t.csv"), guard, ["a"])
    assert sinks.read_csv(spark, str(out / "t.csv"), "a int, b string").count() == 2
    sinks.write_parquet(df, str(out / "t.parquet"), guard, ["a"])
    good = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in sinks.digests(spark, str(out / "t.parquet")).collect() if r["path"].endswith(".parquet")}
    assert sinks.verified_parquet(spark, str(out / "t.parquet"), good).count() == 2
    with pytest.raises(ValueError, match="differ"):
        sinks.verified_parquet(spark, str(out / "t.parquet"), dict.fromkeys(good, "0"))
    ledger = sinks.Ledger(str(tmp_path / "runs"))
    ledger.begin("r", {"x": 1})
    ledger.fail("r", "lost")
    ledger.begin("r", {"x": 1})
    ledger.complete("r", [str(out / "t.csv")])
    assert ledger.status("r") == "complete" and ledger.index(spark).first()["attempts"] == 2
    with pytest.raises(ValueError, match="frozen"):
        ledger.begin("r", {"x": 2})
    (out / "t.csv").write_text("changed")
    assert ledger.status("r") == "broken"
    guard.remove(str(out / "t.csv"))
    assert sinks.frozen({"a": {"b": 1}, "c": 2}, {"a": {"b": 3}, "d": 4}) == ["a.b: 1 became 3", "c is missing", "d is new"]
