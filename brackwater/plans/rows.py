"""Queries of parsing, scalar functions, row quality and row identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions import quality, scalars
from brackwater.operators import dedup
from brackwater.plans.views import SENSOR, P, sensor
from brackwater.shared import table

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


_TRIMMED = "coalesce(trim(line, chr(32) || chr(9) || chr(13) || chr(10)), '')"
_KIND = "case " + " ".join(f"when regexp_matches({_TRIMMED}, '{pattern}') then '{kind}'" for kind, pattern in scalars.LINE_KINDS) + " else 'device_log' end"


@query("C01_line_kind", f"select file_id, {_KIND} as kind, count(*) as n from raw_lines group by all")
def _(spark, d):
    return table(spark, d, "raw_lines").groupBy("file_id", scalars.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


_T = r"""select line_id, case when regexp_matches(line, '^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}(:\d{2})?([,.;\t]|$)')
  then epoch(try_strptime(regexp_extract(line, '^(\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}(:\d{2})?)([,.;\t]|$)', 1) || case when regexp_matches(line, '^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}([,.;\t]|$)') then ':00' else '' end, '%Y-%m-%d %H:%M:%S'))::bigint
  when regexp_matches(line, '^\d{2}-\d{2} \d{2}:\d{2}:\d{2}([,.;\t]|$)') then epoch(try_strptime('2024-' || regexp_extract(line, '^(\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1), '%Y-%m-%d %H:%M:%S'))::bigint end as ts_s
from raw_lines where regexp_matches(line, '^\d{2,4}-\d{2}')"""


@query("C02_parse_time", _T)
def _(spark, d):
    rows = table(spark, d, "raw_lines").where(F.col("line").rlike(r"^\d{2,4}-\d{2}"))
    return rows.select("line_id", scalars.parse_time(F.col("line"), F.lit(2024)).alias("ts_s"))


@query("C03_infer_year", r"""
with m as (select d.row_id, try_cast(regexp_extract(trim(ts_raw), '^(\d{2})-\d{2} ', 1) as int) as mo, try_cast(chunk_key[1:4] as int) as y, try_cast(chunk_key[6:7] as int) as a, year_hint
  from data_rows d left join (select file_id, min(year_hint) as year_hint from log_files group by 1) f using (file_id) where regexp_matches(trim(ts_raw), '^\d{2}-\d{2} '))
select row_id, case when mo - a > 6 then y - 1 when a - mo > 6 then y + 1 when y is not null then y else year_hint end as year from m""")
def _(spark, d):
    files = table(spark, d, "log_files").groupBy("file_id").agg(F.min("year_hint").alias("year_hint"))
    rows = table(spark, d, "data_rows").where(F.trim("ts_raw").rlike(r"^\d{2}-\d{2} ")).join(files, "file_id", "left")
    month = F.regexp_extract(F.trim("ts_raw"), r"^(\d{2})-\d{2} ", 1).try_cast("int")
    anchor = lambda a, n: F.substring("chunk_key", a, n).try_cast("int")
    return rows.select("row_id", scalars.infer_year(month, anchor(1, 4), anchor(6, 2), F.col("year_hint")).alias("year"))


@query("C04_values_and_schema", r"""
with b as (select line_id, list_filter(list_transform(string_split(line, ','), lambda x: case when regexp_full_match(trim(x), '-?[0-9]+(\.[0-9]+)?') then try_cast(trim(x) as double) end), lambda x: x is not null) as v from raw_lines where regexp_matches(line, '^\d{2,4}-\d{2}[^;\t]*,'))
select line_id, len(v) as n_values, case len(v) when 8 then 'p6_t_h' when 9 then 'dev_p6_t_h' else 'nonstandard_' || len(v)::varchar end as row_schema, list_sum(v) as total from b""")
def _(spark, d):
    rows = table(spark, d, "raw_lines").where(F.col("line").rlike(r"^\d{2,4}-\d{2}[^;\t]*,")).withColumn("v", scalars.numbers(F.col("line"), ","))
    n = F.size("v")
    total = F.when(n > 0, F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return rows.select("line_id", n.cast("long").alias("n_values"), scalars.value_schema(n).alias("row_schema"), total.alias("total"))


_WORDS = r"list_filter(regexp_split_to_array(trim(event_raw), '\s+'), lambda x: x <> '')"
_MOVE = f"coalesce(case when {_WORDS}[-1] in ('LM', 'RM', 'UM', 'DM', 'NM') then {_WORDS}[-1] end, '')"


@query("C05_event_tokens", f"select event_raw, {_MOVE} as movement, array_to_string(case when {_MOVE} <> '' then {_WORDS}[1:len({_WORDS}) - 1] else {_WORDS} end, ' ') as codes, count(*) as n from sensor_rows where event_raw is not null group by event_raw")
def _(spark, d):
    events = table(spark, d, "sensor_rows").where(F.col("event_raw").isNotNull()).groupBy("event_raw").agg(F.count("*").alias("n"))
    return events.select("event_raw", scalars.movement(F.col("event_raw")).alias("movement"), F.array_join(scalars.control_codes(F.col("event_raw")), " ").alias("codes"), "n")


@query("C06_redact", "select record_id, regexp_replace(full_text, '[0-9]{4,}', '<redacted>', 'g') as clean, full_text <> regexp_replace(full_text, '[0-9]{4,}', '<redacted>', 'g') as redacted from upload_records")
def _(spark, d):
    clean = scalars.redact(F.col("full_text"), 4)
    return table(spark, d, "upload_records").select("record_id", clean.alias("clean"), (F.col("full_text") != clean).alias("redacted"))


@query("C07_row_fingerprint", f"with {SENSOR} select row_id, md5(concat_ws('|', ts_s, p1, p2, p3, p4, p5, p6, temperature, humidity, event_raw)) as fingerprint from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("ts_s", *P, "temperature", "humidity", "event_raw")])).alias("fingerprint"))


@query("C08_path_parts", r"select file_id, regexp_extract(relpath, '(\d+)\.[a-z]+$', 1) as number, regexp_extract(relpath, '^([^/]+)/', 1) as folder, regexp_extract(relpath, '\.([a-z]+)$', 1) as extension from log_files")
def _(spark, d):
    part = lambda p: F.regexp_extract("relpath", p, 1)
    return table(spark, d, "log_files").select("file_id", part(r"(\d+)\.[a-z]+$").alias("number"), part(r"^([^/]+)/").alias("folder"), part(r"\.([a-z]+)$").alias("extension"))


@query("C09_stable_file_id", "select distinct relpath, 'rf_' || substr(sha1(relpath), 1, 10) as stable_id from log_files")
def _(spark, d):
    return table(spark, d, "log_files").select("relpath", scalars.file_id(F.col("relpath")).alias("stable_id")).distinct()


@query("C10_text_code")
def _(spark, d):
    """64-bit codes of texts, and how many texts share one."""
    texts = table(spark, d, "documents").where(F.col("text").isNotNull()).select("text").distinct()
    return texts.groupBy(F.xxhash64("text").alias("code")).agg(F.count("*").alias("n_texts"))


@query("C11_mixed_code")
def _(spark, d):
    return sensor(spark, d).select("row_id", F.xxhash64("row_id", "ts_s").alias("mixed"))


@query("C12_night", f"with {SENSOR} select row_id, (date '1970-01-01' + ((ts_s - 43200) // 86400)::int)::date::varchar as night_id, night from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", scalars.night_id(F.col("ts_s")).alias("night_id"), "night")


_DATE = "(date '1970-01-01' + (ts_s // 86400)::int)::date"


@query("C13_calendar", f"""with {SENSOR}, c as (select distinct {_DATE} as day_date from s)
select day_date::varchar as day, strftime(day_date, '%Y-%m') as month, isoyear(day_date) as iso_year, week(day_date) as iso_week, quarter(day_date) as quarter,
  (case when month(day_date) <= 2 then year(day_date) - 1 else year(day_date) end)::varchar || case when month(day_date) in (12, 1, 2) then '-winter' when month(day_date) <= 5 then '-spring' when month(day_date) <= 8 then '-summer' else '-autumn' end as season from c""")
def _(spark, d):
    c = sensor(spark, d).select(scalars.date_of(F.col("ts_s")).alias("x")).distinct()
    return c.select(F.col("x").cast("string").alias("day"), F.date_format("x", "yyyy-MM").alias("month"), F.extract(F.lit("YEAROFWEEK"), "x").cast("long").alias("iso_year"),
                    F.weekofyear("x").cast("long").alias("iso_week"), F.quarter("x").cast("long").alias("quarter"), scalars.season(F.col("x")).alias("season"))


@query("C14_hours", f"with {SENSOR} select row_id, (ts_s % 86400) // 3600 as hour, round((ts_s % 86400) / 3600.0 - 12 + case when (ts_s % 86400) / 3600.0 < 12 then 24 else 0 end, 6) as noon_hour from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", scalars.div(F.col("ts_s") % 86_400, 3_600).alias("hour"), F.round(scalars.noon_hour(F.col("ts_s")), 6).alias("noon_hour"))


@query("C15_month_sequence", f"with {SENSOR}, r as (select min({_DATE}) as a, max({_DATE}) as b from s) select strftime(unnest(generate_series(date_trunc('month', a)::timestamp, b::timestamp, interval 1 month)), '%Y-%m') as month from r")
def _(spark, d):
    r = sensor(spark, d).agg(scalars.date_of(F.min("ts_s")).alias("a"), scalars.date_of(F.max("ts_s")).alias("b"))
    months = F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("interval 1 month")))
    return r.select(months.alias("x")).select(F.date_format("x", "yyyy-MM").alias("month"))


@query("C16_relative_night", f"with {SENSOR}, a as (select subject_id, min((ts_s - 43200) // 86400) * 86400 as anchor from s group by 1) select row_id, 'D' || lpad(((ts_s - 43200 - anchor) // 86400 + 1)::varchar, 4, '0') as night_key from s join a using (subject_id)")
def _(spark, d):
    s = sensor(spark, d)
    anchors = s.groupBy("subject_id").agg((F.min("night") * 86_400).alias("anchor"))
    return s.join(anchors, "subject_id").select("row_id", scalars.night_key(F.col("ts_s"), F.col("anchor")).alias("night_key"))


@query("C17_relative_time", f"with {SENSOR}, r as (select row_id, ts_s - 1704067200 as x from s) select row_id, 'D' || lpad((x // 86400 + 1)::varchar, 4, '0') || ' ' || lpad(((x % 86400) // 3600)::varchar, 2, '0') || ':' || lpad(((x % 3600) // 60)::varchar, 2, '0') || ':' || lpad((x % 60)::varchar, 2, '0') as relative, x as seconds from r")
def _(spark, d):
    text = sensor(spark, d).select("row_id", scalars.relative(F.col("ts_s") - 1_704_067_200).alias("relative"))
    return text.withColumn("seconds", scalars.relative_seconds(F.col("relative")))


@query("C19_round_half_up", f"with {SENSOR} select row_id, floor(temperature / 4.0 + 0.5)::bigint as quarter_degrees from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", scalars.round_half_up(F.col("temperature") / 4.0).alias("quarter_degrees"))


@query("C20_number_format", f"with {SENSOR} select row_id, replace(printf('%.2f', (temperature - 30) / 4.0), '-', '−') as printed from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", scalars.typographic((F.col("temperature") - 30) / 4.0, 2).alias("printed"))


_TQ = "case when temperature is null or humidity is null then 'missing' when temperature > 60 or humidity > 100 or temperature < 0 or humidity < 0 then 'extreme_glitch' when temperature = 0 and humidity = 0 then 'zero_sentinel' when temperature = 0 or humidity = 0 then 'zero_value' else 'ok' end"
_PQ = "case when coalesce(p1, p2, p3, p4, p5, p6) is null then 'invalid_schema' when p1 is null or p2 is null or p3 is null or p4 is null or p5 is null or p6 is null then 'missing_channel' when least(p1, p2, p3, p4, p5, p6) < 0 or greatest(p1, p2, p3, p4, p5, p6) > 4095 then 'invalid_encoding' when 4095 in (p1, p2, p3, p4, p5, p6) then 'upper_bound' else 'ok' end"


@query("D01_target_quality", f"with {SENSOR} select row_id, {_TQ} as flag from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", quality.target_quality(F.col("temperature"), F.col("humidity")).alias("flag"))


@query("D02_pressure_quality", f"select row_id, {_PQ} as flag, (p1 is not distinct from 4095)::int + (p2 is not distinct from 4095)::int + (p3 is not distinct from 4095)::int + (p4 is not distinct from 4095)::int + (p5 is not distinct from 4095)::int + (p6 is not distinct from 4095)::int as n_at_bound from sensor_rows")
def _(spark, d):
    p = [F.col(c).cast("long") for c in P]
    return table(spark, d, "sensor_rows").select("row_id", quality.pressure_quality(p, F.coalesce(*p).isNotNull()).alias("flag"), quality.at_bound(p).alias("n_at_bound"))


def _state(x: str, low: int, high: int) -> str:
    return f"case when {x} is null then 'missing' when isnan({x}) or isinf({x}) and false then 'non_finite' when {x} = 0 then 'zero' when {x} < {low} then 'extreme_low' when {x} > {high} then 'extreme_high' else 'valid' end"


@query("D03_target_states", f"""with t as (select row_id, {_state('temp', -10, 60)} as t_state, {_state('humid', 0, 100)} as h_state from sensor_rows)
select *, case when t_state = 'zero' and h_state = 'zero' then 'joint_zero' when starts_with(t_state, 'extreme') or starts_with(h_state, 'extreme') then 'extreme' when t_state = 'zero' or h_state = 'zero' then 'single_zero' else 'plain' end as pattern from t""")
def _(spark, d):
    rows = table(spark, d, "sensor_rows").select("row_id", quality.channel_state(F.col("temp"), -10, 60).alias("t_state"), quality.channel_state(F.col("humid"), 0, 100).alias("h_state"))
    return rows.withColumn("pattern", quality.row_pattern(F.col("t_state"), F.col("h_state")))


@query("D04_plausible", f"with {SENSOR} select count(*) as n_plausible from s where temperature > 0 and temperature < 60 and humidity > 0 and humidity <= 100")
def _(spark, d):
    return sensor(spark, d).where(quality.plausible(F.col("temperature"), F.col("humidity"))).agg(F.count("*").alias("n_plausible"))


@query("D05_policies", f"""with {SENSOR}, q as (select *, {_TQ} as flag from s)
select policy, count(*) filter (where hit) as rows_hit, count(distinct case when hit then subject_id || night::varchar end) as nights_hit
from (select 'A' as policy, flag = 'zero_sentinel' as hit, subject_id, night from q union all select 'B', flag in ('zero_sentinel', 'zero_value'), subject_id, night from q union all select 'C', flag <> 'ok', subject_id, night from q) group by policy""")
def _(spark, d):
    flag = quality.target_quality(F.col("temperature"), F.col("humidity"))
    rules = {"A": flag == "zero_sentinel", "B": flag.isin("zero_sentinel", "zero_value"), "C": flag != "ok"}
    place = F.concat("subject_id", F.col("night").cast("string"))
    one = sensor(spark, d).agg(*[a for k, hit in rules.items() for a in (F.count_if(hit).alias(f"r{k}"), F.count_distinct(F.when(hit, place)).alias(f"n{k}"))])
    stacked = ", ".join(f"'{k}', r{k}, n{k}" for k in rules)
    return one.selectExpr(f"stack({len(rules)}, {stacked}) as (policy, rows_hit, nights_hit)")


@query("D06_phase", f"""with {SENSOR}, b as (select min(night) as lo, max(night) as hi from s)
select subject_id, case when night < lo + (hi - lo) // 3 then 's1' when night = lo + (hi - lo) // 3 then '' else 's2' end as phase, count(*) as n from s, b group by all""")
def _(spark, d):
    s = sensor(spark, d)
    phases = s.agg(F.min("night").alias("lo"), F.max("night").alias("hi")).withColumn("cut", F.col("lo") + F.expr("(hi - lo) div 3"))
    spans = phases.selectExpr("stack(2, 's1', lo, cut - 1, 's2', cut + 1, hi) as (phase, first, last)")
    # Two rows: the range join's build side has a fixed size.
    labelled = s.join(F.broadcast(spans), s["night"].between(spans["first"], spans["last"]), "left")
    return labelled.groupBy("subject_id", F.coalesce("phase", F.lit("")).alias("phase")).agg(F.count("*").alias("n"))


@query("D07_slices", f"""with {SENSOR}, l as (select unnest([case when subject_id = 'U01' then 'first' end, case when device_id <> 'unknown' then 'paired' end, subject_id, 'all']) as slice, row_id from s)
select slice, count(*) as n from l where slice is not null group by slice""")
def _(spark, d):
    labels = F.array_compact(F.array(F.when(F.col("subject_id") == "U01", "first"), F.when(F.col("device_id") != "unknown", "paired"), "subject_id", F.lit("all")))
    return sensor(spark, d).select(F.explode(labels).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))


@query("D08_frame_flags", f"with {SENSOR} select row_id, p1 + p2 + p3 + p4 + p5 + p6 = 0 as all_zero, (p1 > 0)::int + (p2 > 0)::int + (p3 > 0)::int + (p4 > 0)::int + (p5 > 0)::int + (p6 > 0)::int as n_active, lag((p1, p2, p3, p4, p5, p6)) over (partition by subject_id, device_id order by ts_s, row_id) <> (p1, p2, p3, p4, p5, p6) as changed from s")
def _(spark, d):
    from brackwater.operators.ordered import neighbour

    p = [F.col(c) for c in P]
    rows = neighbour(sensor(spark, d), ["subject_id", "device_id"], ["ts_s", "row_id"], "day", P, "_b")
    before = F.array(*[F.col("_b")[c] for c in P])
    changed = F.when(F.col("_b").isNotNull(), before != F.array(*p))
    return rows.select("row_id", (quality.total(p) == 0).alias("all_zero"), quality.active(p).alias("n_active"), changed.alias("changed"))


@query("D10_informative", f"with {SENSOR} select subject_id, count(*) as n from s where p1 + p2 + p3 + p4 + p5 + p6 > 0 group by 1")
def _(spark, d):
    return sensor(spark, d).where(quality.total([F.col(c) for c in P]) > 0).groupBy("subject_id").agg(F.count("*").alias("n"))


@query("D11_heater_events", "select row_id, ts, event_raw from sensor_rows where regexp_matches(event_raw, 'AHON|AHOF') and subject_id = 'U000001'")
def _(spark, d):
    return table(spark, d, "sensor_rows").where((F.col("subject_id") == "U000001") & F.col("event_raw").rlike("AHON|AHOF")).select("row_id", "ts", "event_raw")


@query("D11_heater_events_all", "select subject_id, row_id, ts, event_raw from sensor_rows where regexp_matches(event_raw, 'AHON|AHOF')")
def _(spark, d):
    return table(spark, d, "sensor_rows").where(F.col("event_raw").rlike("AHON|AHOF")).select("subject_id", "row_id", "ts", "event_raw")


@query("D12_identity", "select distinct s.subject_id, s.device_id from sensor_rows s anti join (select subject_id, device_id from log_files) f on s.subject_id = f.subject_id and s.device_id = f.device_id")
def _(spark, d):
    owners = table(spark, d, "log_files").select("subject_id", "device_id").distinct()
    return table(spark, d, "sensor_rows").select("subject_id", "device_id").distinct().join(owners, ["subject_id", "device_id"], "left_anti")


# Rows sent twice: blocks of the stream again in a second file, one row alone, one block cut to the minute.
DUP = SENSOR + """,
dup as (select s.*, 'f' || file_no::varchar as file_id, row_id as pos from s
  union all select s.*, 'g1', row_id from s where row_id % 1000 between 200 and 239
  union all select s.*, 'g2', row_id from s where row_id % 1000 = 215
  union all select * replace (ts_s // 60 * 60 as ts_s), 'g3', row_id from s where row_id % 1000 between 300 and 349)"""


def dup_rows(spark, d) -> DataFrame:
    s = sensor(spark, d)
    part = F.col("row_id") % 1_000
    parts = [s.withColumn("file_id", F.concat(F.lit("f"), F.col("file_no").cast("string"))), s.where(part.between(200, 239)).withColumn("file_id", F.lit("g1")),
             s.where(part == 215).withColumn("file_id", F.lit("g2")), s.where(part.between(300, 349)).withColumn("ts_s", F.expr("ts_s div 60 * 60")).withColumn("file_id", F.lit("g3"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumn("pos", F.col("row_id"))


_V = "p1, p2, p3, p4, p5, p6, temperature, humidity"


@query("E01_minute_fingerprint", f"with {DUP} select subject_id, count(distinct (ts_s, {_V})) as exact, count(distinct (ts_s // 60, {_V})) as by_minute from dup group by 1")
def _(spark, d):
    v = [F.col(c) for c in (*P, "temperature", "humidity")]
    return dup_rows(spark, d).groupBy("subject_id").agg(F.count_distinct("ts_s", *v).alias("exact"), F.count_distinct(F.expr("ts_s div 60"), *v).alias("by_minute"))


@query("E02_sequence_fingerprint", f"""with {DUP}, k as (select *, row_number() over w as rn, count(*) over (partition by file_id, subject_id, device_id) as n,
  md5(concat_ws('|', {_V}) || '/' || concat_ws('|', {', '.join(f'lead({c}, 1) over w' for c in _V.split(', '))}) || '/' || concat_ws('|', {', '.join(f'lead({c}, 2) over w' for c in _V.split(', '))})) as gram
  from dup window w as (partition by file_id, subject_id, device_id order by pos))
select gram, count(*) as n_places, count(distinct file_id) as n_files, min(pos) as first_pos from k where rn <= n - 2 group by gram having count(*) > 1""")
def _(spark, d):
    return dedup.sequence_matches(dup_rows(spark, d), ["file_id", "subject_id", "device_id"], "pos", [*P, "temperature", "humidity"], 3)


@query("E05_duplicate_counts", f"""with {DUP}, c as (select subject_id, device_id, ts_s, count(distinct ({_V})) as k from dup group by all)
select d.*, c.conflicting_times from (select subject_id, device_id, count(*) as raw_rows, count(distinct (ts_s, {_V}, event_raw)) as unique_full, count(distinct (ts_s, {_V})) as unique_values, count(distinct ts_s) as unique_times from dup group by all) d
join (select subject_id, device_id, count(*) filter (where k > 1) as conflicting_times from c group by all) c using (subject_id, device_id)""")
def _(spark, d):
    return dedup.duplicate_counts(dup_rows(spark, d), ["subject_id", "device_id"], "ts_s", [*P, "temperature", "humidity"], "event_raw")


@query("E06_file_ranges", f"""with {DUP}, g as (select *, ts_s - lag(ts_s) over (partition by file_id order by ts_s, pos) as gap from dup)
select file_id, count(*) as n_rows, min(ts_s) as first_s, max(ts_s) as last_s, count(distinct ts_s) as n_times, count(*) filter (where gap > 5) as gaps_5, count(*) filter (where gap > 1800) as gaps_1800, max(gap) as max_gap from g group by 1""")
def _(spark, d):
    return dedup.file_ranges(dup_rows(spark, d), "file_id", "ts_s", "pos", "day")


@query("E07_overlapping_files", f"""with {DUP}, r as (select file_id, min(ts_s) as lo, max(ts_s) as hi from dup group by 1),
p as (select a.file_id as file_a, b.file_id as file_b from r a join r b on a.lo <= b.hi and b.lo <= a.hi and a.file_id < b.file_id),
k as (select distinct file_id, subject_id, device_id, ts_s, {_V} from dup)
select file_a, file_b, count(x.file_id) as shared from p left join (select a.file_id, b.file_id as other from k a join k b using (subject_id, device_id, ts_s, {_V}) where a.file_id < b.file_id) x on x.file_id = file_a and x.other = file_b group by 1, 2""")
def _(spark, d):
    return dedup.overlapping_files(dup_rows(spark, d), "file_id", "ts_s", ["subject_id", "device_id", "ts_s", *P, "temperature", "humidity"])


@query("E08_first_occurrence", f"with {DUP} select file_id, pos, min(pos) over (partition by subject_id, device_id, ts_s, {_V}) as first_pos from dup where file_id in ('g1', 'g2')")
def _(spark, d):
    keys = ["subject_id", "device_id", "ts_s", *P, "temperature", "humidity"]
    rows = dup_rows(spark, d).where(F.col("file_id").isin("g1", "g2"))
    return rows.join(rows.groupBy(*keys).agg(F.min("pos").alias("first_pos")), keys).select("file_id", "pos", "first_pos")


_RUNS = f"""m as (select a.file_id as file_a, b.file_id as file_b, a.pos as pos_a, b.pos as pos_b from dup a join dup b using (subject_id, device_id, ts_s, {_V}) where a.file_id < b.file_id and b.file_id like 'g%'),
n as (select *, pos_a - row_number() over (partition by file_a, file_b, pos_b - pos_a order by pos_a) as island from m),
runs as (select file_a, file_b, pos_b - pos_a as shift, min(pos_a) as first_a, max(pos_a) as last_a, count(*) as n from n group by file_a, file_b, pos_b - pos_a, island)"""


@query("E09_aligned_runs", f"with {DUP}, {_RUNS} select * from runs")
def _(spark, d):
    return dedup.aligned_runs(dup_rows(spark, d), "file_id", "pos", ["subject_id", "device_id", "ts_s", *P, "temperature", "humidity"], F.col("file_id").startswith("g"))


@query("E12_repeated_sequences", f"with {DUP}, {_RUNS} select * from runs where n >= 10")
def _(spark, d):
    return Q["E09_aligned_runs"](spark, d).where("n >= 10")


@query("E13_upload_copies", f"with {DUP}, {_RUNS} select distinct r.file_b as file_id, d.pos from runs r join dup d on d.file_id = r.file_b and d.pos between r.first_a + r.shift and r.last_a + r.shift where r.n >= 10")
def _(spark, d):
    rows = dup_rows(spark, d)
    runs = Q["E12_repeated_sequences"](spark, d)
    return dedup.run_members(rows, runs, "file_id", "pos")


@query("E14_copy_roots", f"""with recursive {SENSOR}, e as (select row_id as copy, row_id - 100 as orig from s where row_id % 1000 between 200 and 450),
c as (select copy, orig from e union all select c.copy, e.orig from c join e on c.orig = e.copy)
select copy, min(orig) as root from c group by copy""")
def _(spark, d):
    edges = sensor(spark, d).where((F.col("row_id") % 1_000).between(200, 450)).select(F.col("row_id").alias("copy"), (F.col("row_id") - 100).alias("orig"))
    return dedup.roots(edges, "copy", "orig")


@query("E15_provenance", f"""with {DUP}, g as (select *, row_number() over w - 1 as occurrence, count(*) over (partition by subject_id, device_id, ts_s, {_V}, event_raw) as n_copies, first_value(pos) over w as canonical_pos
  from dup window w as (partition by subject_id, device_id, ts_s, {_V}, event_raw order by file_id, pos))
select file_id, pos, canonical_pos, occurrence, n_copies, occurrence = 0 as is_canonical from g where n_copies > 1""")
def _(spark, d):
    keys = ["subject_id", "device_id", "ts_s", *P, "temperature", "humidity", "event_raw"]
    return dedup.provenance(dup_rows(spark, d), keys, ["file_id", "pos"], "pos").where("n_copies > 1").select("file_id", "pos", "canonical_pos", "occurrence", "n_copies", "is_canonical")


@query("E16_first_per_time", f"with {DUP} select subject_id, device_id, ts_s, min(pos) as pos, count(*) as n_rows, count(distinct ({_V})) as n_values from dup group by 1, 2, 3")
def _(spark, d):
    return dup_rows(spark, d).groupBy("subject_id", "device_id", "ts_s").agg(F.min("pos").alias("pos"), F.count("*").alias("n_rows"), F.count_distinct(*P, "temperature", "humidity").alias("n_values"))


@query("E17_identical_files", "select md5(headers) as digest, count(*) as n_files, min(file_id) as first_file from log_files where headers is not null group by 1 having count(*) > 1")
def _(spark, d):
    files = table(spark, d, "log_files").where(F.col("headers").isNotNull())
    return files.groupBy(F.md5("headers").alias("digest")).agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file")).where("n_files > 1")


@query("E18_manifest_diff", """with a as (select distinct file_id, sep as v from log_files where right(file_id, 1) <> '3'), b as (select distinct file_id, case when right(file_id, 1) = '5' then '?' else sep end as v from log_files where right(file_id, 1) <> '7')
select coalesce(a.file_id, b.file_id) as file_id, case when b.file_id is null then 'removed' when a.file_id is null then 'added' else 'modified' end as change from a full join b on a.file_id = b.file_id where a.v is distinct from b.v""")
def _(spark, d):
    files = table(spark, d, "log_files").select("file_id", "sep").distinct()
    last = F.right(F.col("file_id"), F.lit(1))
    old = files.where(last != "3").select("file_id", F.col("sep").alias("digest"))
    new = files.where(last != "7").select("file_id", F.when(last == "5", "?").otherwise(F.col("sep")).alias("digest"))
    return dedup.manifest_diff(old, new, "file_id", "digest")


@query("E19_window_union", "select subject_id, device_id, t0, bool_or(labelled) as in_a, bool_or(temperature > 25) as in_b from windows where t0 is not null and (labelled or temperature > 25) group by 1, 2, 3")
def _(spark, d):
    w = table(spark, d, "windows").where(F.col("t0").isNotNull())
    return dedup.union_with_membership({"in_a": w.where("labelled"), "in_b": w.where("temperature > 25")}, ["subject_id", "device_id", "t0"]).select("subject_id", "device_id", "t0", "in_a", "in_b")


@query("E20_bucket_overlap", f"""with {SENSOR}, b as (select distinct subject_id, ts_s // 60 as minute, device_id from s), x as (select distinct minute from b where device_id = 'd0'), y as (select distinct minute from b where device_id = 'd1')
select (select count(*) from x) as only_a_or_both, (select count(*) from y) as only_b_or_both, (select count(*) from x semi join y using (minute)) as both, (select count(*) from x anti join y using (minute)) as only_a, (select count(*) from y anti join x using (minute)) as only_b""")
def _(spark, d):
    s = sensor(spark, d).select(F.expr("ts_s div 60").alias("minute"), "device_id").where(F.col("device_id").isin("d0", "d1"))
    seen = s.groupBy("minute").agg(F.bool_or(F.col("device_id") == "d0").alias("a"), F.bool_or(F.col("device_id") == "d1").alias("b"))
    a, b = F.col("a"), F.col("b")
    return seen.agg(F.count_if(a).alias("only_a_or_both"), F.count_if(b).alias("only_b_or_both"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


@query("E21_chunk_keys", "select chunk_key, count(distinct file_id) as n_files, count(*) as n_rows from data_rows where chunk_key is not null group by 1 having count(distinct file_id) > 1")
def _(spark, d):
    return table(spark, d, "data_rows").where(F.col("chunk_key").isNotNull()).groupBy("chunk_key").agg(F.count_distinct("file_id").alias("n_files"), F.count("*").alias("n_rows")).where("n_files > 1")


@query("E22_cross_device", f"with {SENSOR} select count(*) as shared_times from (select distinct ts_s from s where device_id = 'd0' intersect select distinct ts_s from s where device_id = 'd1')")
def _(spark, d):
    s = sensor(spark, d)
    return s.where("device_id = 'd0'").select("ts_s").intersect(s.where("device_id = 'd1'").select("ts_s")).agg(F.count("*").alias("shared_times"))


@query("E23_subject_pairs", f"""with {SENSOR}, k as (select distinct subject_id, ts_s // 60 as minute, temperature, humidity from s)
select a.subject_id as subject_a, b.subject_id as subject_b, count(*) as matched, count(*) >= 10 as suspicious from k a join k b using (minute, temperature, humidity) where a.subject_id < b.subject_id group by 1, 2""")
def _(spark, d):
    k = sensor(spark, d).select("subject_id", F.expr("ts_s div 60").alias("minute"), "temperature", "humidity").distinct()
    return dedup.cross_matches(k, "subject_id", ["minute", "temperature", "humidity"]).select(F.col("a").alias("subject_a"), F.col("b").alias("subject_b"), "matched", (F.col("matched") >= 10).alias("suspicious"))


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
