"""Queries of sources and digests, text scans, release checks, comparison, look-ups and reshaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions import scalars
from brackwater.operators import compare
from brackwater.plans.views import PLACED, PREDICTED, SENSOR, P, placed, predicted, sensor
from brackwater.shared import table
from brackwater.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_FILES = "f as (select file_id, min(source_id) as source_id, min(relpath) as relpath, min(encoding) as encoding, min(n_lines) as n_lines, min(sep) as sep, min(subject_id) as subject_id from log_files group by 1)"


def files(spark, d) -> DataFrame:
    return table(spark, d, "log_files").groupBy("file_id").agg(*[F.min(c).alias(c) for c in ("source_id", "relpath", "encoding", "n_lines", "sep", "subject_id")])


@query("A04_resolve_source", f"with {_FILES}, p as (select distinct regexp_extract(relpath, '^(.*_)\\d+\\.', 1) as prefix, source_id from f), m as (select f.file_id, p.source_id, row_number() over (partition by f.file_id order by length(prefix) desc, p.source_id) as rk from f join p on starts_with(relpath, prefix)) select file_id, source_id from m where rk = 1")
def _(spark, d):
    f = files(spark, d)
    prefixes = f.select(F.regexp_extract("relpath", r"^(.*_)\d+\.", 1).alias("prefix"), "source_id").distinct()
    return logs.resolve_sources(f.select("file_id", "relpath"), prefixes, "relpath", "prefix", "source_id").select("file_id", "source_id")


@query("A06_eligible_sources", f"with {_FILES} select source_id, count(*) as n_files, sum(n_lines)::bigint as n_lines from f where encoding <> 'utf-8-replace' group by 1")
def _(spark, d):
    return files(spark, d).where("encoding <> 'utf-8-replace'").groupBy("source_id").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"))


@query("A07_source_load", f"with {_FILES} select f.source_id, count(*) as n_lines, count(distinct l.file_id) as n_files from raw_lines l join f using (file_id) group by 1")
def _(spark, d):
    return table(spark, d, "raw_lines").join(files(spark, d).select("file_id", "source_id"), "file_id").groupBy("source_id").agg(F.count("*").alias("n_lines"), F.count_distinct("file_id").alias("n_files"))


@query("A08_typed_rows", "select source_id, count(*) filter (where ts is null) as undated, count(*) filter (where temp is null or humid is null) as without_target, count(*) filter (where p1 is null or p2 is null or p3 is null or p4 is null or p5 is null or p6 is null) as without_channel from sensor_rows group by 1")
def _(spark, d):
    missing = lambda cs: F.exists(F.array(*[F.col(c).isNull() for c in cs]), lambda x: x)
    return table(spark, d, "sensor_rows").groupBy("source_id").agg(F.count_if(F.col("ts").isNull()).alias("undated"), F.count_if(missing(["temp", "humid"])).alias("without_target"), F.count_if(missing(P)).alias("without_channel"))


@query("A09_pruned_scan", "select device_id, count(*) as n, max(p1) as p1_high from sensor_rows where subject_id = 'U000004' group by 1")
def _(spark, d):
    return table(spark, d, "sensor_rows").where("subject_id = 'U000004'").groupBy("device_id").agg(F.count("*").alias("n"), F.max("p1").alias("p1_high"))


@query("A09_scan_by_subject", "select subject_id, device_id, count(*) as n, max(p1) as p1_high from sensor_rows group by 1, 2")
def _(spark, d):
    return table(spark, d, "sensor_rows").groupBy("subject_id", "device_id").agg(F.count("*").alias("n"), F.max("p1").alias("p1_high"))


@query("A11_row_violations", "select count(*) as violations from sensor_rows where not coalesce(p1 between 0 and 4095 and p2 between 0 and 4095 and p3 between 0 and 4095 and p4 between 0 and 4095 and p5 between 0 and 4095 and p6 between 0 and 4095, false)")
def _(spark, d):
    ok = F.lit(True)
    for c in P:
        ok = ok & F.col(c).between(0, 4_095)
    return table(spark, d, "sensor_rows").where(~F.coalesce(ok, F.lit(False))).agg(F.count("*").alias("violations"))


@query("A12_prediction_pairs", f"with {PREDICTED} select row_id, seed, max(p) filter (where target = 'temperature') as temperature_p, max(p) filter (where target = 'humidity') as humidity_p from pred group by 1, 2")
def _(spark, d):
    wide = predicted(placed(spark, d)).groupBy("row_id", "seed").pivot("target", ["temperature", "humidity"]).agg(F.max("p"))
    return wide.select("row_id", "seed", F.col("temperature").alias("temperature_p"), F.col("humidity").alias("humidity_p"))


@query("B08_table_digest")
def _(spark, d):
    return compare.digest(table(spark, d, "upload_records"))


@query("B09_key_digest", "select subject_id, sha256(string_agg(k, chr(10) order by k)) as digest from (select distinct subject_id, night_id || '|' || device_id as k from windows where night_id is not null) group by 1")
def _(spark, d):
    keys = table(spark, d, "windows").where("night_id is not null").select("subject_id", F.concat_ws("|", "night_id", "device_id").alias("k")).distinct()
    # One key a night and device of a subject: bounded by the calendar.
    return keys.groupBy("subject_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("digest"))


@query("B12_snapshot_difference", "with a as (select line_id, md5(line) as h from raw_lines where line_id % 10 <> 1), b as (select line_id, md5(case when line_id % 10 = 5 then line || '!' else line end) as h from raw_lines where line_id % 10 <> 2) select count(*) filter (where b.line_id is null) as removed, count(*) filter (where a.line_id is null) as added, count(*) filter (where a.h <> b.h) as modified from a full join b using (line_id)")
def _(spark, d):
    lines = table(spark, d, "raw_lines")
    last = F.col("line_id") % 10
    a = lines.where(last != 1).select("line_id", F.md5("line").alias("ha"), F.lit(1).alias("ia"))
    b = lines.where(last != 2).select("line_id", F.md5(F.when(last == 5, F.concat("line", F.lit("!"))).otherwise(F.col("line"))).alias("hb"), F.lit(1).alias("ib"))
    both = a.join(b, "line_id", "full_outer")
    return both.agg(F.count_if(F.col("ib").isNull()).alias("removed"), F.count_if(F.col("ia").isNull()).alias("added"), F.count_if(F.col("ha") != F.col("hb")).alias("modified"))


_FIND = ", ".join(f"case when regexp_matches(m, '{p}') then '{n}' end" for n, p in compare.PATTERNS.items())


@query("P01_text_scan", f"select doc_id, finding from (select doc_id, unnest([{_FIND}]) as finding from (select doc_id, regexp_replace(text, '{compare.HASH}', '<hash>', 'g') as m from documents)) where finding is not null")
def _(spark, d):
    return compare.text_findings(table(spark, d, "documents"), "doc_id", "text")


@query("P02_release_checks", "select count(*) filter (where not regexp_full_match(subject_id, 'U\\d{6}')) as bad_subject, count(*) filter (where temperature not between -10 and 60) as bad_temperature, count(*) filter (where t0 is null) as without_start from windows")
def _(spark, d):
    return table(spark, d, "windows").agg(F.count_if(~F.col("subject_id").rlike(r"^U\d{6}\z")).alias("bad_subject"), F.count_if(~F.col("temperature").between(-10, 60)).alias("bad_temperature"), F.count_if(F.col("t0").isNull()).alias("without_start"))


@query("P03_anonymised_events", f"with {SENSOR}, a as (select subject_id, min(night) as n0 from s group by 1) select row_id, 'D' || lpad((night - n0 + 1)::varchar, 4, '0') as night_key, ts_s - n0 * 86400 as rel_s, event_raw from s join a using (subject_id) where event_raw <> 'LM'")
def _(spark, d):
    s = sensor(spark, d)
    a = s.groupBy("subject_id").agg(F.min("night").alias("n0"))
    key = F.concat(F.lit("D"), F.lpad((F.col("night") - F.col("n0") + 1).cast("string"), 4, "0"))
    return s.where("event_raw <> 'LM'").join(a, "subject_id").select("row_id", key.alias("night_key"), (F.col("ts_s") - F.col("n0") * 86_400).alias("rel_s"), "event_raw")


@query("P05_equivalence", "select (select count(*) from (select window_id, temperature from windows except all select window_id, temperature from windows where labelled)) as only_a, (select count(*) from (select window_id, temperature from windows where labelled except all select window_id, temperature from windows)) as only_b")
def _(spark, d):
    w = table(spark, d, "windows").select("window_id", "temperature", "labelled")
    a, b = w.select("window_id", "temperature"), w.where("labelled").select("window_id", "temperature")
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).withColumn("only_b", b.exceptAll(a).agg(F.count("*")).scalar())


_CELLS = "select window_id, 'temperature' as \"column\", temperature as v from {t} union all select window_id, 'humidity', humidity from {t}"


@query("P06_table_difference", f"""with w as (select window_id, temperature, humidity from windows), x as (select window_id, case when window_id % 100 = 7 then temperature + 1 else temperature end as temperature, humidity from w where window_id % 100 <> 9),
a as ({_CELLS.format(t='w')}), b as ({_CELLS.format(t='x')})
select coalesce(a.window_id, b.window_id) as window_id, coalesce(a."column", b."column") as "column", a.v as a, b.v as b from a full join b on a.window_id = b.window_id and a."column" = b."column" where a.v is distinct from b.v""")
def _(spark, d):
    w = table(spark, d, "windows").select("window_id", "temperature", "humidity")
    x = w.where("window_id % 100 <> 9").withColumn("temperature", F.when(F.col("window_id") % 100 == 7, F.col("temperature") + 1).otherwise(F.col("temperature")))
    return compare.table_difference(w, x, ["window_id"], ["temperature", "humidity"])


@query("P07_tolerance", "select count(*) filter (where abs(l_quantity - l_extendedprice / 1000) <= 1) as within, count(*) as n from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count_if(compare.within(F.col("l_quantity").cast("double"), (F.col("l_extendedprice") / 1_000).cast("double"), 1.0)).alias("within"), F.count("*").alias("n"))


@query("Q02_cross_check", "select count(*) as cells, count(*) filter (where abs(a.v - b.v) > 1e-6) as differing from (select subject_id, avg(temperature) as v from windows group by 1) a join (select subject_id, sum(temperature) / count(temperature) as v from windows group by 1) b using (subject_id)")
def _(spark, d):
    w = table(spark, d, "windows").groupBy("subject_id")
    both = w.agg(F.avg("temperature").alias("a")).join(w.agg((F.sum("temperature") / F.count("temperature")).alias("b")), "subject_id")
    return both.agg(F.count("*").alias("cells"), F.count_if(~compare.within(F.col("a"), F.col("b"), 1e-6)).alias("differing"))


@query("Q03_report_table", f"with {PREDICTED}, m as (select subject_id, target, seed, avg(abs(p - y)) as e from pred group by all) select subject_id, round(avg(e) filter (where target = 'temperature'), 6) as temperature_mae, round(avg(e) filter (where target = 'humidity'), 6) as humidity_mae from m group by 1")
def _(spark, d):
    m = predicted(placed(spark, d)).groupBy("subject_id", "target", "seed").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("e"))
    wide = m.groupBy("subject_id").pivot("target", ["temperature", "humidity"]).agg(F.round(F.avg("e"), 6))
    return wide.select("subject_id", F.col("temperature").alias("temperature_mae"), F.col("humidity").alias("humidity_mae"))


@query("R01_time_order", f"with {SENSOR} select row_id, row_number() over (partition by subject_id, device_id order by ts_s, file_no, row_id) as place from s")
def _(spark, d):
    from brackwater.operators.ordered import running_sum

    return running_sum(sensor(spark, d).withColumn("_1", F.lit(1).cast("long")), ["subject_id", "device_id"], ["ts_s", "file_no", "row_id"], "day", "_1", "place").select("row_id", "place")


@query("R03_top_pairs", "select event_raw, device_id, count(*) as n from sensor_rows where event_raw is not null group by 1, 2 order by n desc, event_raw, device_id limit 20")
def _(spark, d):
    c = table(spark, d, "sensor_rows").where("event_raw is not null").groupBy("event_raw", "device_id").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "event_raw", "device_id").limit(20)  # a top-k report


@query("R04_extremes", "select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest from orders group by 1")
def _(spark, d):
    at = F.struct("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("dearest"), F.min_by("o_orderkey", at).alias("cheapest"))


@query("R05_concatenation", "select 'sensor' as source, device_id, count(*) as n from sensor_rows group by 2 union all select 'upload', device_id, count(*) from upload_records group by 2")
def _(spark, d):
    a, b = (table(spark, d, t).groupBy("device_id").agg(F.count("*").alias("n")).withColumn("source", F.lit(n)) for t, n in (("sensor_rows", "sensor"), ("upload_records", "upload")))
    return a.unionByName(b, allowMissingColumns=True)


@query("R07_melt", f"with {SENSOR} select row_id, unnest(['temperature', 'humidity']) as target, unnest([temperature, humidity]) as y from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", "temperature", "humidity").unpivot(["row_id"], ["temperature", "humidity"], "target", "y")


@query("R09_pivot", f"with {SENSOR} select subject_id, count(*) filter (where event_raw = 'LM') as lm, count(*) filter (where event_raw = 'AHON') as ahon, count(*) filter (where event_raw = 'AHOF UM') as ahof from s group by 1")
def _(spark, d):
    wide = sensor(spark, d).groupBy("subject_id").pivot("event_raw", ["LM", "AHON", "AHOF UM"]).count().na.fill(0)
    return wide.select("subject_id", F.col("LM").alias("lm"), F.col("AHON").alias("ahon"), F.col("AHOF UM").alias("ahof"))


@query("R11_narrowing", "select row_id, nullif(p1, -32768)::bigint as p1, case when temp = round(temp) then temp::bigint end as whole_temp from sensor_rows")
def _(spark, d):
    t = F.col("temp")
    return table(spark, d, "sensor_rows").select("row_id", F.nullif(F.col("p1").cast("long"), F.lit(-32_768)).alias("p1"), F.when(t == F.rint(t), t.try_cast("long")).alias("whole_temp"))


@query("R12_stream_catalog", "select subject_id, device_id, string_agg(distinct source_id, ',' order by source_id) as sources, count(*) as n from sensor_rows group by 1, 2")
def _(spark, d):
    # Sources of a stream, not its rows, are collected.
    by = table(spark, d, "sensor_rows").groupBy("subject_id", "device_id", "source_id").agg(F.count("*").alias("n"))
    return by.groupBy("subject_id", "device_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"), F.sum("n").alias("n"))


@query("R14_schema_mix", "select file_id, count(*) filter (where row_schema = 'p6_t_h') as p6_t_h, count(*) filter (where row_schema = 'dev_p6_t_h') as dev_p6_t_h, count(distinct row_schema) > 1 as mixed from data_rows group by 1")
def _(spark, d):
    s = F.col("row_schema")
    return table(spark, d, "data_rows").groupBy("file_id").agg(F.count_if(s == "p6_t_h").alias("p6_t_h"), F.count_if(s == "dev_p6_t_h").alias("dev_p6_t_h"), (F.count_distinct(s) > 1).alias("mixed"))


@query("R15_target_summary", "select device_id, count(*) as n, count(*) filter (where temp is null) as missing, count(*) filter (where temp = 0) as zero, count(*) filter (where temp not between -10 and 60) as extreme, count(distinct temp) as n_values from sensor_rows group by 1")
def _(spark, d):
    t = F.col("temp")
    return table(spark, d, "sensor_rows").groupBy("device_id").agg(F.count("*").alias("n"), F.count_if(t.isNull()).alias("missing"), F.count_if(t == 0).alias("zero"), F.count_if(~t.between(-10, 60)).alias("extreme"), F.count_distinct(t).alias("n_values"))


@query("R16_control_flag", f"select event_raw, regexp_matches(event_raw, '{'|'.join(scalars.CONTROL_WORDS)}') as control, count(*) as n from sensor_rows where event_raw is not null group by 1")
def _(spark, d):
    e = table(spark, d, "sensor_rows").where("event_raw is not null").groupBy("event_raw").agg(F.count("*").alias("n"))
    return e.select("event_raw", scalars.is_control(F.col("event_raw")).alias("control"), "n")


@query("R17_edges", f"with {PLACED} select subject_id, device_id, session, count(*) filter (where row_id < a) as leading, count(*) filter (where row_id > b) as trailing, count(*) filter (where row_id between a and b and event_raw = 'LM') as inner_plain from placed join (select subject_id, device_id, session, min(row_id) as a, max(row_id) as b from placed where event_raw <> 'LM' group by all) x using (subject_id, device_id, session) group by 1, 2, 3")
def _(spark, d):
    rows = placed(spark, d)
    keys = ["subject_id", "device_id", "session"]
    x = rows.where("event_raw <> 'LM'").groupBy(*keys).agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"))
    r = F.col("row_id")
    return rows.join(x, keys).groupBy(*keys).agg(F.count_if(r < F.col("a")).alias("leading"), F.count_if(r > F.col("b")).alias("trailing"), F.count_if(r.between(F.col("a"), F.col("b")) & (F.col("event_raw") == "LM")).alias("inner_plain"))


@query("R18_unit_reducer", f"with {SENSOR}, u as (select subject_id, night, quantile_cont(p1, 0.95) - quantile_cont(p1, 0.05) as x from s group by all) select subject_id, quantile_cont(x, 0.5) as spread from u group by 1")
def _(spark, d):
    u = sensor(spark, d).groupBy("subject_id", "night").agg((F.percentile("p1", 0.95) - F.percentile("p1", 0.05)).alias("x"))
    return u.groupBy("subject_id").agg(F.percentile("x", 0.5).alias("spread"))


@query("R20_pairs", f"with {SENSOR}, m as (select subject_id, avg(temperature) as m from s group by 1) select a.subject_id as a, b.subject_id as b, round(a.m - b.m, 6) as difference from m a join m b on a.subject_id < b.subject_id")
def _(spark, d):
    m = sensor(spark, d).groupBy("subject_id").agg(F.avg("temperature").alias("m"))
    b = m.select(F.col("subject_id").alias("b"), F.col("m").alias("mb"))
    # One row a slice: the pairs of slices are the wanted report.
    return m.select(F.col("subject_id").alias("a"), "m").join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.col("m") - F.col("mb"), 6).alias("difference"))


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
