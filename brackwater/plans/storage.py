"""Queries of sources, sinks, integrity records, runs and releases: each writes into the shared folder and reads back from it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.operators import compare, fits, sessions, splits
from brackwater.plans.core import oracle_sql as core_sql
from brackwater.shared import shared_folder, table
from brackwater.sources import logs, sinks

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}
FREE = sinks.Guard([])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def place(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/brackwater-{tag}-{uuid.uuid4().hex}"


@F.pandas_udf(T.BinaryType())
def _cp949(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x.encode("cp949", "replace"), na_action="ignore")


def one_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_files").where("file_id is not null").groupBy("file_id").agg(F.min("encoding").alias("encoding"), F.bool_or("has_bom").alias("has_bom"))


def raw_files(spark: SparkSession, d: str, value: Column) -> str:
    """Write the lines as files, one a file id; `value` gives the bytes of a line."""
    lines = table(spark, d, "raw_lines").where("line is not null and file_id is not null")
    first = lines.groupBy("file_id").agg(F.min(F.struct("line_no", "line_id")).alias("_first"))
    rows = lines.join(first, "file_id").join(one_file(spark, d), "file_id", "left").withColumn("is_first", F.struct("line_no", "line_id") == F.col("_first")).withColumn("value", value)
    folder = place(spark, "raw")
    sinks.write_lines(rows, folder, FREE, "file_id", ["line_no", "line_id"], "value")
    return folder


def _file() -> Column:
    return F.regexp_extract("path", r"key=([^/]+)/", 1)

_KEPT = "k as (select *, row_number() over (partition by file_id order by line_no, line_id) as no from raw_lines where line is not null and file_id is not null)"


@query("A01_raw_scan", f"with {_KEPT} select file_id, no::int as line_no, sha256(case when no = 1 then ltrim(line, chr(65279)) else line end) as digest from k")
def _(spark, d):
    folder = raw_files(spark, d, F.when(F.col("is_first") & F.col("has_bom"), F.concat(F.lit("﻿"), F.ltrim("line", F.lit("﻿")))).otherwise(F.col("line")))
    return logs.read_lines(spark, folder).select(_file().alias("file_id"), "line_no", F.sha2("line", 256).alias("digest"))


@query("A02_encodings", f"""with {_KEPT}, f as (select file_id, min(encoding) as encoding from log_files group by 1),
x as (select k.file_id, bool_or(encoding = 'cp949' and regexp_matches(line, '[가-힣]')) as korean from k left join f using (file_id) group by 1)
select case when korean then 'cp949' else 'utf-8-sig' end as encoding, count(*) as n_files from x group by 1""")
def _(spark, d):
    plain = F.regexp_replace("line", "[^\\x00-\\x7F가-힣]", "?")
    folder = raw_files(spark, d, F.when(F.col("encoding") == "cp949", _cp949(F.when(F.col("encoding") == "cp949", plain)).cast("string")).otherwise(F.col("line")))
    lines = logs.read_lines(spark, folder)
    return lines.select(_file().alias("file_id"), "encoding").distinct().groupBy("encoding").agg(F.count("*").alias("n_files"))


@query("A10_verified_scan", "select subject_id, count(*) as n, sum(t0)::bigint as starts from windows group by 1")
def _(spark, d):
    at = place(spark, "verified")
    sinks.write_parquet(table(spark, d, "windows"), f"{at}/table", FREE)
    sinks.record(spark, f"{at}/table", f"{at}/manifest")
    rows = sinks.verified_parquet(spark, f"{at}/table", spark.read.parquet(f"{at}/manifest"))
    return rows.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("t0").alias("starts"))


@query("A13_csv_scan", "select spec_code, bin_s, max_gap_s, duration_s, stride_s from window_specs")
def _(spark, d):
    at = place(spark, "csv")
    specs = table(spark, d, "window_specs")
    sinks.write_csv(specs, f"{at}/specs.csv", FREE, specs.columns)
    return sinks.read_csv(spark, f"{at}/specs.csv", "spec_code string, bin_s int, max_gap_s int, duration_s int, stride_s int")


@query("A15_frozen_lookup", "select alias, field from field_aliases where field in ('temp', 'humid')")
def _(spark, d):
    at = place(spark, "frozen")
    sinks.write_csv(table(spark, d, "field_aliases"), f"{at}/aliases.csv", FREE, ["alias", "field"])
    frozen = sinks.read_csv(spark, f"{at}/aliases.csv", "alias string, field string")
    return frozen.where(F.col("field").isin("temp", "humid"))


@query("B01_guarded_paths", "with v as (select distinct relpath, unnest([relpath, upper(relpath), 'x/../' || relpath, './/' || relpath, 'other/' || relpath]) as path from log_files) select path, relpath like 'u00000%' and path not like 'other/%' as refused from v")
def _(spark, d):
    spelled = F.array("relpath", F.upper("relpath"), F.concat(F.lit("x/../"), "relpath"), F.concat(F.lit(".//"), "relpath"), F.concat(F.lit("other/"), "relpath"))
    paths = table(spark, d, "log_files").select(F.explode(spelled).alias("path")).distinct()
    return paths.select("path", F.regexp_replace(sinks.resolved(F.col("path")), r"^\./", "").rlike("^u00000").alias("refused"))


@query("B02_parquet_sink", "select subject_id, device_id, session_id, segment, t0, count(*) as n from windows group by all")
def _(spark, d):
    at = place(spark, "sink")
    sinks.write_parquet(table(spark, d, "windows"), at, FREE, ["subject_id", "t0"])
    return spark.read.parquet(at).groupBy("subject_id", "device_id", "session_id", "segment", "t0").agg(F.count("*").alias("n"))


@query("B03_csv_sink", "select sha256('n,source' || chr(10) || string_agg(n || ',' || source, chr(10) order by n::varchar, source) || chr(10)) as digest from (select count(*) as n, source from documents where source is not null group by 2)")
def _(spark, d):
    counts = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    at = f"{place(spark, 'csv')}/counts.csv"
    sinks.write_csv(counts, at, FREE, ["n", "source"])
    return sinks.digests(spark, at).select(F.col("sha256").alias("digest"))


@query("B04_json_sink", "select sha256('{' || chr(10) || '  \"documents\": ' || count(*) || chr(10) || '}' || chr(10)) as digest from documents")
def _(spark, d):
    at = f"{place(spark, 'json')}/counts.json"
    sinks.write_json(at, {"documents": table(spark, d, "documents").count()}, FREE)
    return sinks.digests(spark, at).select(F.col("sha256").alias("digest"))


@query("B05_safe_delete", "select * from (values ('file', 'deleted'), ('folder', 'refused'), ('missing', 'refused'), ('protected', 'refused')) v(item, outcome)")
def _(spark, d):
    at = place(spark, "delete")
    guard = sinks.Guard([f"{at}/raw"])
    for name in ("plain.json", "raw/kept.json", "folder/inner.json"):
        sinks.write_json(f"{at}/{name}", {}, FREE)
    out = []
    for item, path in (("file", "plain.json"), ("folder", "folder"), ("missing", "none.json"), ("protected", "folder/../RAW/kept.json")):
        try:
            guard.remove(f"{at}/{path}")
            out.append((item, "deleted"))
        except (ValueError, PermissionError):
            out.append((item, "refused"))
    left = sinks.Store(spark)
    assert not left.exists(f"{at}/plain.json") and left.exists(f"{at}/raw/kept.json")
    return spark.createDataFrame(out, "item string, outcome string")


@query("B06_file_digest", f"with {_KEPT} select file_id, sha256(string_agg(line, chr(10) order by no) || chr(10)) as digest from k group by 1")
def _(spark, d):
    return sinks.digests(spark, raw_files(spark, d, F.col("line"))).select(_file().alias("file_id"), F.col("sha256").alias("digest"))


@query("B07_file_digest_lf", f"with {_KEPT} select file_id, sha256(replace(string_agg(line, chr(10) order by no) || chr(10), chr(13) || chr(10), chr(10))) as digest from k group by 1")
def _(spark, d):
    return logs.normalised_digest(spark, raw_files(spark, d, F.col("line"))).select(_file().alias("file_id"), F.col("sha256").alias("digest"))


def _ledger(spark: SparkSession) -> tuple[sinks.Ledger, str]:
    at = place(spark, "runs")
    return sinks.Ledger(f"{at}/ledger"), at


@query("B10_run_states", "select * from (values ('again', 'complete', 2), ('broken', 'broken', 1), ('failed', 'failed', 1), ('open', 'running', 1), ('whole', 'complete', 1)) v(run, status, attempts)")
def _(spark, d):
    ledger, at = _ledger(spark)
    for run in ("again", "broken", "failed", "open", "whole"):
        ledger.begin(run, {"seed": 0})
        sinks.write_json(f"{at}/{run}.json", {"run": run}, FREE)
    ledger.fail("failed", "lost")
    ledger.fail("again", "lost")
    ledger.begin("again", {"seed": 0})
    for run in ("again", "broken", "whole"):
        ledger.complete(run, [f"{at}/{run}.json"])
    sinks.write_json(f"{at}/broken.json", {"run": "other"}, FREE)
    return ledger.index(spark)


@query("B11_access_log", "select subject_id, count(*) as accesses, count(distinct seed) as seeds from (select distinct subject_id from windows), (values (0), (1), (1)) v(seed) group by 1")
def _(spark, d):
    at = place(spark, "access")
    subjects = table(spark, d, "windows").select("subject_id").distinct()
    for seed in (0, 1, 1):
        sinks.log_access(subjects.withColumn("seed", F.lit(seed)), at, FREE)
    return spark.read.schema("subject_id string, seed int").json(at).groupBy("subject_id").agg(F.count("*").alias("accesses"), F.count_distinct("seed").alias("seeds"))


@query("B13_design_freeze", "select spec_code, sha256(concat_ws('|', bin_s, max_gap_s, duration_s, stride_s)) as digest, 'refused' as changed from window_specs")
def _(spark, d):
    ledger, _ = _ledger(spark)
    out = []
    for r in table(spark, d, "window_specs").collect():  # one row a setting
        settings = r.asDict()
        ledger.begin(r["spec_code"], settings)
        try:
            ledger.begin(r["spec_code"], settings | {"bin_s": -1})
            changed = "accepted"
        except ValueError:
            changed = "refused"
        digest = hashlib.sha256("|".join(str(settings[k]) for k in ("bin_s", "max_gap_s", "duration_s", "stride_s")).encode()).hexdigest()
        out.append((r["spec_code"], digest, changed))
    return spark.createDataFrame(out, "spec_code string, digest string, changed string")


_LOSO = """w as (select subject_id, temperature as y from windows where labelled and temperature is not null), s as (select subject_id, count(*) as n, sum(y) as y from w group by 1),
t as (select sum(n) as n, sum(y) as y from s), c as (select subject_id, (t.y - s.y) / (t.n - s.n) as p from s, t where t.n > s.n)"""


def _held_out_means(w: DataFrame) -> DataFrame:
    """Training mean of every held-out subject: all others' sums, from one aggregate a subject."""
    s = w.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    n, y = s.agg(F.sum("n")).scalar(), s.agg(F.sum("s")).scalar()
    return s.where(F.col("n") < n).select("subject_id", ((y - F.col("s")) / (n - F.col("n"))).alias("p"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "windows").where("labelled and temperature is not null").select("subject_id", F.col("temperature").alias("y"))


@query("B14_run_index", "select * from (values ('final', 'complete', 1), ('inner', 'complete', 1)) v(run, status, attempts)")
def _(spark, d):
    ledger, at = _ledger(spark)
    gate = splits.gate({"no_negative_span": lambda: sessions.found(table(spark, d, "windows")).where("end_s < start_s")})
    for name in ("inner", "final"):
        fits.run(ledger, FREE, name, {"run": name}, gate, lambda: table(spark, d, "window_specs"), f"{at}/{name}.csv")
        fits.run(ledger, FREE, name, {"run": name}, gate, lambda: table(spark, d, "window_specs"), f"{at}/{name}.csv")  # complete and intact: kept
    return ledger.index(spark)


@query("C21_config_drift", """with a as (select spec_code, unnest(['bin_s', 'max_gap_s', 'stride_s']) as field, unnest([bin_s, max_gap_s, stride_s])::varchar as expected from window_specs),
b as (select spec_code, unnest(['bin_s', 'max_gap_s', 'stride_s']) as field, unnest([bin_s, max_gap_s * 2, case when stride_s > 20 then stride_s + 1 else stride_s end])::varchar as given from window_specs where bin_s <> 1)
select spec_code, field, expected, given from a full join b using (spec_code, field) where expected is distinct from given""")
def _(spark, d):
    specs = table(spark, d, "window_specs")
    given = specs.where("bin_s <> 1").withColumn("max_gap_s", F.col("max_gap_s") * 2).withColumn("stride_s", F.when(F.col("stride_s") > 20, F.col("stride_s") + 1).otherwise(F.col("stride_s")))
    return sinks.setting_differences(specs, given, "spec_code", ["bin_s", "max_gap_s", "stride_s"])


@query("K07_run_checks", f"""with {_LOSO}, f as (select c.subject_id as fold, s.subject_id as fitted from c join s on s.subject_id <> c.subject_id)
select 'fit_on_held_out' as check_name, count(*) filter (where fold = fitted) as violations from f
union all select 'night_of_start', count(*) from windows where t0 is not null and night_id is not null and night_id <> strftime(make_timestamp((t0 - 43200) * 1000000), '%Y-%m-%d')
union all select 'features_outside_list', 2""")
def _(spark, d):
    windows = table(spark, d, "windows")
    w = _labelled(spark, d)
    # The fit of a fold is a difference of sums: it holds the held-out subject if its count is not that of the others.
    counts = w.groupBy("subject_id").agg(F.count("*").alias("n"))
    fitted = _held_out_means(w).join(counts, "subject_id").where(F.col("p").isNull())
    night = F.date_from_unix_date(F.expr("(t0 - 43200) div 86400").cast("int")).cast("string")
    allowed = {"window_id", "subject_id", "device_id", "session_id", "segment", "sensor_phase", "night_id", "t0", "prov", "labelled", "received_at"}
    names = spark.createDataFrame([(n,) for n in fits.features_allowed(windows.columns, allowed, ("target",))], "name string")
    return splits.gate({"fit_on_held_out": lambda: fitted, "night_of_start": lambda: windows.where((F.col("t0").isNotNull()) & (F.col("night_id") != night)), "features_outside_list": lambda: names})


@query("L12_runs", f"with {_LOSO} select c.subject_id as run, round(avg(abs(w.y - c.p)), 6) as mae, count(*) as n from w join c using (subject_id) group by 1")
def _(spark, d):
    ledger, at = _ledger(spark)
    w = _labelled(spark, d)
    gate = splits.gate({"unlabelled": lambda: w.where("y is null")})
    result = lambda: w.join(_held_out_means(w), "subject_id").groupBy(F.col("subject_id").alias("run")).agg(F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae"), F.count("*").alias("n"))
    fits.run(ledger, FREE, "final", {"model": "training mean"}, gate, result, f"{at}/final.csv")
    return sinks.read_csv(spark, f"{at}/final.csv", "run string, mae double, n long")


_SCORES = "sc as (select device_id, spec_code, round(avg(abs(temp - 22)), 6) as score from sensor_rows where temp is not null and device_id is not null group by 1, 2), best as (select device_id, arg_min(spec_code, (score, spec_code)) as spec_code from sc group by 1)"


@query("L13_frozen_selection", f"with {_SCORES} select device_id, spec_code, 'granted' as access from best")
def _(spark, d):
    at = place(spark, "selection")
    scores = table(spark, d, "sensor_rows").where("temp is not null and device_id is not null").groupBy("device_id", "spec_code").agg(F.avg(F.abs(F.col("temp") - 22)).alias("score"))
    chosen = fits.selection(scores.withColumn("score", F.round("score", 6)), ["device_id"], "spec_code", "score")
    sinks.write_parquet(chosen, f"{at}/selection", FREE, ["device_id"])
    sinks.record(spark, f"{at}/selection", f"{at}/manifest")  # the commit that must stand before test access
    return sinks.verified_parquet(spark, f"{at}/selection", spark.read.parquet(f"{at}/manifest")).withColumn("access", F.lit("granted"))


@query("P04_structural_diff", """select * from (values ('budgets[1]: 3 became 4'), ('nights.U1 is missing'), ('nights.U2: ''2024-01-02'' became ''2024-01-05'''), ('seed is new')) v(difference)""")
def _(spark, d):
    private = {"budgets": [1, 3, 7], "nights": {"U1": "2024-01-01", "U2": "2024-01-02", "U3": "2024-01-03"}}
    public = {"budgets": [1, 4, 7], "nights": {"U2": "2024-01-05", "U3": "D0003"}, "seed": 1}
    return spark.createDataFrame([(x,) for x in sinks.frozen(private, public, allowed={"2024-01-03": "D0003"})], "difference string")


def released(spark: SparkSession, d: str) -> str:
    """Write the release: windows and control events as Parquet, splits and schema as small files, and the manifest of digests; leaks stop it."""
    at = place(spark, "release")
    windows = table(spark, d, "windows").select("subject_id", "device_id", "t0", "prov", "labelled", "temperature", "humidity")
    events = table(spark, d, "sensor_rows").where("event_raw is not null").groupBy("subject_id", "device_id", F.trim("event_raw").alias("code")).agg(F.count("*").alias("n"))
    folds = windows.groupBy("subject_id").agg(F.count("*").alias("n_windows"))
    leaks = splits.gate({"text": lambda: compare.text_findings(events.select(F.col("code").alias("k"), "code"), "k", "code"), "subject": lambda: folds.where(~F.col("subject_id").rlike(r"^U\d{6}$"))})
    splits.require(leaks)
    sinks.write_parquet(windows, f"{at}/windows", FREE, ["subject_id", "t0"])
    sinks.write_parquet(events, f"{at}/events", FREE, ["subject_id"])
    sinks.write_csv(folds, f"{at}/splits/folds.csv", FREE, ["subject_id", "n_windows"])
    sinks.write_json(f"{at}/schema/schema.json", {"windows": dict(windows.dtypes), "events": dict(events.dtypes)}, FREE)
    for part in ("windows", "events"):
        sinks.record(spark, f"{at}/{part}", f"{at}/manifest/{part}")
    return at


@query("P08_release_build", """select 'windows' as part, count(*) as n from windows union all select 'events', count(*) from (select distinct subject_id, device_id, trim(event_raw) from sensor_rows where event_raw is not null)
union all select 'folds', count(distinct subject_id) + max(case when subject_id is null then 1 else 0 end) from windows""")
def _(spark, d):
    at = released(spark, d)
    parts = {p: sinks.verified_parquet(spark, f"{at}/{p}", spark.read.parquet(f"{at}/manifest/{p}")) for p in ("windows", "events")}
    parts["folds"] = sinks.read_csv(spark, f"{at}/splits/folds.csv", "subject_id string, n_windows long")
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("P09_public_mode", core_sql()["p4_found"])
def _(spark, d):
    at = released(spark, d)
    source = {"windows": lambda: sinks.verified_parquet(spark, f"{at}/windows", spark.read.parquet(f"{at}/manifest/windows"))}
    return sessions.found(source["windows"]())


@query("Q01_unique_cells", """with k as (select distinct subject_id, device_id from sensor_rows where subject_id is not null), c as (select subject_id, count(device_id) as n, min(device_id) as device_id from k group by 1)
select subject_id, case when n = 1 then device_id end as device_id, case when n = 1 then 'one' when n = 0 then 'none' else 'many' end as outcome from c""")
def _(spark, d):
    cells = table(spark, d, "sensor_rows").where("subject_id is not null").select("subject_id", "device_id").distinct()
    return compare.unique_cells(cells, ["subject_id"], "device_id")


@query("Q04_traceability", """with c as (select source_id, round(avg(n_lines), 2) as cell from log_files where source_id is not null group by 1), t as (select source_id, case when source_id like '%3' then cell + 0.01 else cell end as printed from c)
select t.source_id, printed, cell from t join c using (source_id) where round(printed, 2) <> round(cell, 2)""")
def _(spark, d):
    cells = table(spark, d, "log_files").where("source_id is not null").groupBy("source_id").agg(F.round(F.avg("n_lines"), 2).alias("cell"))
    printed = cells.select("source_id", F.when(F.col("source_id").endswith("3"), F.col("cell") + 0.01).otherwise(F.col("cell")).alias("printed"))
    return compare.untraceable(printed, cells, ["source_id"], 2)


def queries() -> dict[str, Query]:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
