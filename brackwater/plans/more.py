"""Further queries: keys and channels of sources, feasibility, stacked tables, evidence and check lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.functions import quality, scalars
from brackwater.operators import dedup, joins, series, splits, stats
from brackwater.operators.ordered import global_rank, islands, longest_true, neighbour
from brackwater.plans.models import _BOOT, _ERR, _ORDINAL, _SES, WIN, bootstrap, labelled, made, sessions_of
from brackwater.plans.rows import DUP, dup_rows
from brackwater.plans.series import _CTX, _STEP, heater, steps
from brackwater.plans.views import PLACED, PREDICTED, SENSOR, P, placed, predicted, sensor
from brackwater.shared import table

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}
ST, ORD = ["subject_id", "device_id"], ["ts_s", "row_id"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("A03_file_list", "select distinct relpath, source_id from log_files order by relpath")
def _(spark, d):
    return table(spark, d, "log_files").select("relpath", "source_id").distinct().orderBy("relpath")


@query("A05_source_catalog", "select source_id, min(subject_id) as subject_id, min(device_id) as device_id, count(distinct file_id) as n_files, min(uploaded_at) as first_upload, max(uploaded_at) as last_upload from log_files group by 1")
def _(spark, d):
    return table(spark, d, "log_files").groupBy("source_id").agg(F.min("subject_id").alias("subject_id"), F.min("device_id").alias("device_id"), F.count_distinct("file_id").alias("n_files"), F.min("uploaded_at").alias("first_upload"), F.max("uploaded_at").alias("last_upload"))


@query("A14_step_columns", f"with {WIN} select last[2] as target_row, steps[2][4] as s1_p2, steps[4][6] as s3_p4 from win")
def _(spark, d):
    return made(spark, d).select("target_row", F.col("steps")[1]["p"][1].alias("s1_p2"), F.col("steps")[3]["p"][3].alias("s3_p4"))


@query("C18_gap_bins", f"with {_STEP} select case when step < 0 then 'overlap' when step <= 10 then '0-10s' when step <= 60 then '10-60s' when step <= 300 then '60-300s' when step <= 1800 then '300-1800s' when step <= 7200 then '1800-7200s' else '>7200s' end as bin, count(*) as n from st where step is not null group by 1")
def _(spark, d):
    return steps(spark, d).where("step is not null").groupBy(scalars.gap_bin(F.col("step")).alias("bin")).agg(F.count("*").alias("n"))


@query("D09_labelled_windows", f"with {WIN} select count(*) as n from win where last[9] between 1 and 59 and last[10] between 1 and 100")
def _(spark, d):
    return labelled(spark, d).where(F.col("temperature").between(1, 59) & F.col("humidity").between(1, 100)).agg(F.count("*").alias("n"))


@query("E03_row_keys", f"with {SENSOR} select row_id, md5(concat_ws('|', ts_s, p1, p2, p3, p4, p5, p6, temperature, humidity)) as value_key, md5(concat_ws('|', file_no, ts_s, p1, p2, p3, p4, p5, p6, temperature, humidity, event_raw)) as file_key from s")
def _(spark, d):
    text = lambda cs: F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cs]))
    v = ["ts_s", *P, "temperature", "humidity"]
    return sensor(spark, d).select("row_id", text(v).alias("value_key"), text(["file_no", *v, "event_raw"]).alias("file_key"))


@query("E04_common_channels", "with c as (select source_id, unnest(['p1', 'p2', 'p3', 'p4', 'p5', 'p6']) as channel, unnest([max(p1), max(p2), max(p3), max(p4), max(p5), max(p6)]) as top from sensor_rows group by source_id) select a.source_id as a, b.source_id as b, count(*) as n_common from c a join c b on a.channel = b.channel and a.source_id < b.source_id where a.top > 0 and b.top > 0 group by 1, 2")
def _(spark, d):
    tops = table(spark, d, "sensor_rows").groupBy("source_id").agg(*[F.max(c).alias(c) for c in P])
    c = tops.unpivot(["source_id"], P, "channel", "top").where("top > 0")
    b = c.select(F.col("source_id").alias("b"), "channel")
    # One row a source and channel: the wanted report has one row a pair of sources.
    return c.select(F.col("source_id").alias("a"), "channel").join(b, "channel").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"))


@query("E10_longest_streak", f"with {SENSOR}, f as (select *, p4 > 0 as on_, row_number() over (partition by subject_id, device_id order by ts_s, row_id) - row_number() over (partition by subject_id, device_id, p4 > 0 order by ts_s, row_id) as isl from s), r as (select subject_id, device_id, on_, isl, count(*) as n from f group by all) select subject_id, device_id, coalesce(max(n) filter (where on_), 0) as longest from r group by 1, 2")
def _(spark, d):
    return longest_true(sensor(spark, d).withColumn("_on", F.col("p4") > 0), ST, ORD, "day", "_on")


@query("E11_within_file_runs", f"with {DUP}, m as (select file_id, pos, ts_s, temperature, lag(temperature) over (partition by file_id order by pos) as before from dup) select file_id, count(*) filter (where temperature = before) as adjacent_equal from m group by 1")
def _(spark, d):
    rows = dup_rows(spark, d).select("file_id", "pos", "temperature", "day")
    n = neighbour(rows, ["file_id"], ["pos"], "day", ["temperature"], "_b")
    return n.groupBy("file_id").agg(F.count_if(F.col("temperature") == F.col("_b.temperature")).alias("adjacent_equal"))


@query("E24_suspicion", f"with {DUP}, k as (select distinct subject_id, ts_s // 60 as minute, temperature, humidity, p1 from dup) select a.subject_id as a, b.subject_id as b, count(*) as matched, count(*) >= 10 as suspicious from k a join k b using (minute, temperature, humidity, p1) where a.subject_id < b.subject_id group by 1, 2")
def _(spark, d):
    k = dup_rows(spark, d).select("subject_id", F.expr("ts_s div 60").alias("minute"), "temperature", "humidity", "p1").distinct()
    return dedup.cross_matches(k, "subject_id", ["minute", "temperature", "humidity", "p1"]).withColumn("suspicious", F.col("matched") >= 10)


@query("F13_endpoint_history", f"with {WIN} select w.last[2] as target_row, count(x.k) as covering from win w left join win x on x.subject_id = w.subject_id and x.device_id = w.device_id and x.segment = w.segment and x.k = w.k - 1 group by 1")
def _(spark, d):
    w = made(spark, d).select("subject_id", "device_id", "segment", "k", "target_row")
    x = w.select("subject_id", "device_id", "segment", (F.col("k") + 1).alias("k"), F.lit(1).alias("_one"))
    return w.join(x, ["subject_id", "device_id", "segment", "k"], "left").groupBy("target_row").agg(F.count("_one").alias("covering"))


@query("G25_feasibility", f"with {PLACED}, g as (select subject_id, device_id, segment, max(ts_s) - min(ts_s) as len from placed group by all) select subject_id, count(*) as segments, count(*) filter (where len >= 35) as windowable, sum(len) filter (where len >= 35)::bigint as seconds, floor(quantile_cont(len, 0.9))::bigint as q90 from g group by 1")
def _(spark, d):
    g = placed(spark, d).groupBy(*ST, "segment").agg((F.max("ts_s") - F.min("ts_s")).alias("len"))
    ok = F.col("len") >= 35
    return g.groupBy("subject_id").agg(F.count("*").alias("segments"), F.count_if(ok).alias("windowable"), F.sum(F.when(ok, F.col("len"))).alias("seconds"), F.floor(F.percentile("len", 0.9)).alias("q90"))


@query("G26_partition_windows", f"with {WIN}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s) select subject_id, case when ordinal <= 7 then 'adapt' when ordinal = 8 then 'buffer' else 'test' end as part, count(*) as n from win join o on o.subject_id = win.subject_id and o.night = win.last[11] group by 1, 2".replace("select subject_id, case", "select win.subject_id, case"))
def _(spark, d):
    o = splits.chronological(series.ordinals(sensor(spark, d)), [7]).select("subject_id", "night", "part")
    return labelled(spark, d).join(o, ["subject_id", "night"]).groupBy("subject_id", "part").agg(F.count("*").alias("n"))


@query("G27_availability", f"with {WIN} select subject_id, h as history_s, count(*) as n, count(*) filter (where t0 + 40 - h >= a) as available from win join sg using (subject_id, device_id, segment), (values (40), (60), (100)) v(h) group by 1, 2")
def _(spark, d):
    w = made(spark, d).withColumn("history_s", F.explode(F.array(*[F.lit(x) for x in (40, 60, 100)])))
    a = placed(spark, d).groupBy("subject_id", "device_id", "segment").agg(F.min("ts_s").alias("a"))
    return w.join(a, ["subject_id", "device_id", "segment"]).groupBy("subject_id", "history_s").agg(F.count("*").alias("n"), F.count_if(F.col("t0") + 40 - F.col("history_s") >= F.col("a")).alias("available"))


@query("G28_night_table", "select subject_id, night_id, count(*) as n, count(*) filter (where labelled) as labelled, count(distinct session_id) as sessions from windows where night_id is not null group by 1, 2")
def _(spark, d):
    return table(spark, d, "windows").where("night_id is not null").groupBy("subject_id", "night_id").agg(F.count("*").alias("n"), F.count_if("labelled").alias("labelled"), F.count_distinct("session_id").alias("sessions"))


@query("H10_channel_runs", f"with {SENSOR}, f as (select *, case when p4 is distinct from lag(p4) over w or ts_s - lag(ts_s) over w > 60 then 1 else 0 end as fresh from s window w as (partition by subject_id, device_id order by ts_s, row_id)), i as (select *, sum(fresh) over (partition by subject_id, device_id order by ts_s, row_id rows unbounded preceding) as run from f), r as (select subject_id, device_id, run, count(*) as n, bool_and(p1 + p2 + p3 + p4 + p5 + p6 = 0) as idle from i group by all) select case when idle then 'idle' else 'loaded' end as category, n, count(*) as runs from r where n > 1 group by 1, 2")
def _(spark, d):
    runs = islands(sensor(spark, d), ST, ORD, "day", ["p4", "ts_s"], lambda p: (p("p4") != F.col("p4")) | (F.col("ts_s") - p("ts_s") > 60), "run")
    r = runs.groupBy(*ST, "run").agg(F.count("*").alias("n"), F.bool_and(quality.total([F.col(c) for c in P]) == 0).alias("idle"))
    return r.where("n > 1").groupBy(F.when(F.col("idle"), "idle").otherwise("loaded").alias("category"), "n").agg(F.count("*").alias("runs"))


@query("I14_budget_windows", f"with {WIN}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s) select last[2] as target_row, budget, case when budget = 0 then 'test' when ordinal <= budget then 'adapt' when ordinal = budget + 1 then 'buffer' else 'test' end as part from win join o on o.subject_id = win.subject_id and o.night = win.last[11], (values (0), (3), (7)) v(budget)")
def _(spark, d):
    o = splits.chronological(series.ordinals(sensor(spark, d)), [0, 3, 7]).select("subject_id", "night", "budget", "part")
    return labelled(spark, d).join(o, ["subject_id", "night"]).select("target_row", "budget", "part")


@query("J06_slice_distances", f"with {SENSOR}, u as (select subject_id, unnest(['temperature', 'humidity']) as variable, unnest([temperature, humidity]) as x from s), pr as (values ('U01', 'U02'), ('U01', 'U03'), ('U02', 'U03')), c as (select pr.col0 as a, pr.col1 as b, variable, x, count(*) filter (where subject_id = col0) as na, count(*) filter (where subject_id = col1) as nb from u join pr on subject_id in (col0, col1) group by all), f as (select *, abs(sum(na) over w / sum(na) over (partition by a, b, variable) - sum(nb) over w / sum(nb) over (partition by a, b, variable)) as dd, lead(x) over (partition by a, b, variable order by x) - x as gap from c window w as (partition by a, b, variable order by x rows unbounded preceding)) select a, b, variable, round(sum(dd * gap), 6) as w1, round(max(dd), 6) as ks from f group by 1, 2, 3")
def _(spark, d):
    u = sensor(spark, d).select("subject_id", "temperature", "humidity").unpivot(["subject_id"], ["temperature", "humidity"], "variable", "x")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("U01", "U02"), ("U01", "U03"), ("U02", "U03"))]))
    x = u.withColumn("_p", pairs).where((F.col("subject_id") == F.col("_p.a")) | (F.col("subject_id") == F.col("_p.b"))).select(F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), "variable", "x", "subject_id")
    return stats.distribution_shift(x, ["a", "b", "variable"], "x", F.col("subject_id") == F.col("b")).select("a", "b", "variable", "w1", "ks")


@query("K04_gate", f"with {_SES} select 'unique_sessions' as check_name, count(*) as violations from (select session from ses group by subject_id, device_id, session having count(*) > 1) union all select 'known_subjects', count(*) from ses where not regexp_full_match(subject_id, 'U0[123]')")
def _(spark, d):
    ses = sessions_of(spark, d)
    return splits.gate({"unique_sessions": lambda: ses.groupBy("subject_id", "device_id", "session").agg(F.count("*").alias("k")).where("k > 1"),
                        "known_subjects": lambda: ses.where(~F.col("subject_id").rlike(r"^U0[123]\z"))})


@query("K10_history_gate", f"with {WIN} select count(*) as windows, count(*) filter (where last[1] >= t0 + 40) as future_steps from win")
def _(spark, d):
    return made(spark, d).agg(F.count("*").alias("windows"), F.count_if(F.exists("steps", lambda s: s["ts"] >= F.col("t0") + 40)).alias("future_steps"))


@query("K12_window_coverage", f"with {WIN} select placed.subject_id, count(distinct placed.segment || placed.device_id) as segments, count(distinct win.segment || win.device_id) as with_windows from placed left join win using (subject_id, device_id, segment) group by 1")
def _(spark, d):
    seg = placed(spark, d).select("subject_id", "device_id", "segment").distinct()
    has = made(spark, d).select("subject_id", "device_id", "segment").distinct().withColumn("_w", F.lit(1))
    return seg.join(has, ["subject_id", "device_id", "segment"], "left").groupBy("subject_id").agg(F.count("*").alias("segments"), F.count("_w").alias("with_windows"))


@query("M11_level_mismatch", f"with {PREDICTED}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s), m as (select subject_id, target, avg(y) filter (where ordinal <= 7) as early, avg(y) filter (where ordinal > 8) as late, avg(p - y) as bias from pred join o using (subject_id, night) where seed = 0 group by all) select subject_id, target, round(late - early, 6) as level_change, case when sign(late - early) = sign(bias) then 'same' else 'other' end as direction from m")
def _(spark, d):
    rows = placed(spark, d)
    x = predicted(rows).where("seed = 0").join(series.ordinals(rows), ["subject_id", "night"])
    at = lambda c: F.avg(F.when(c, F.col("y")))
    m = x.groupBy("subject_id", "target").agg(at(F.col("ordinal") <= 7).alias("e"), at(F.col("ordinal") > 8).alias("l"), F.avg(F.col("p") - F.col("y")).alias("b"))
    return m.select("subject_id", "target", F.round(F.col("l") - F.col("e"), 6).alias("level_change"), F.when(F.signum(F.col("l") - F.col("e")) == F.signum("b"), "same").otherwise("other").alias("direction"))


@query("M12_all_tables", f"with {PREDICTED} select 'subject' as level, subject_id as part, target, {_ERR} from pred where seed = 0 group by subject_id, target union all select 'pooled', 'ALL', target, {_ERR} from pred where seed = 0 group by target")
def _(spark, d):
    x = predicted(placed(spark, d)).where("seed = 0")
    e = stats.errors(F.col("y"), F.col("p"))
    a = x.groupBy(F.col("subject_id").alias("part"), "target").agg(*e).withColumn("level", F.lit("subject"))
    return a.unionByName(x.groupBy("target").agg(*e).withColumns({"part": F.lit("ALL"), "level": F.lit("pooled")})).select("level", "part", "target", "n", "mae", "rmse", "bias")


@query("M15_external_nights", f"with {PREDICTED} select target, night, {_ERR} from pred where seed = 0 and subject_id = 'U03' group by 1, 2")
def _(spark, d):
    return predicted(placed(spark, d)).where("seed = 0 and subject_id = 'U03'").groupBy("target", "night").agg(*stats.errors(F.col("y"), F.col("p")))


@query("M17_calibrated", f"with {PREDICTED}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s), c as (select subject_id, device_id, target, avg(y - p) as c from pred join o using (subject_id, night) where seed = 0 and ordinal <= 7 group by all), x as (select *, unnest(['all', device_id]) as scope from pred join o using (subject_id, night) join c using (subject_id, device_id, target) where seed = 0 and ordinal >= 16) select subject_id, target, scope, round(avg(abs(p - y)), 6) as plain_mae, round(avg(abs(p + c - y)), 6) as calibrated_mae from x group by 1, 2, 3")
def _(spark, d):
    rows = placed(spark, d)
    x = predicted(rows).where("seed = 0").join(series.ordinals(rows), ["subject_id", "night"])
    keys = ["subject_id", "device_id", "target"]
    c = x.where("ordinal <= 7").groupBy(*keys).agg(F.avg(F.col("y") - F.col("p")).alias("c"))
    t = x.where("ordinal >= 16").join(c, keys).withColumn("scope", F.explode(F.array(F.lit("all"), F.col("device_id"))))
    mae = lambda e, n: F.round(F.avg(F.abs(e - F.col("y"))), 6).alias(n)
    return t.groupBy("subject_id", "target", "scope").agg(mae(F.col("p"), "plain_mae"), mae(F.col("p") + F.col("c"), "calibrated_mae"))


@query("N03_intervals", f"with {_BOOT} select subject_id, target, round(quantile_cont(mae_a, 0.025), 6) as lo, round(quantile_cont(mae_a, 0.975), 6) as hi, count(mae_a) as n from boot group by 1, 2")
def _(spark, d):
    return bootstrap(spark, d).groupBy("subject_id", "target").agg(F.round(F.percentile("mae_a", 0.025), 6).alias("lo"), F.round(F.percentile("mae_a", 0.975), 6).alias("hi"), F.count("mae_a").alias("n"))


@query("O03_neighbour_evidence", f"with {SENSOR}, n as (select device_id, night, min(temperature) as lo, max(temperature) as hi, avg(temperature) as m from s where subject_id = 'U02' group by all), w as (select a.device_id, a.night, a.m, min(b.lo) as lo, max(b.hi) as hi from n a join n b on a.device_id = b.device_id and b.night between a.night - 7 and a.night + 7 and b.night <> a.night group by all) select device_id, night, case when m between lo and hi then 'within' else 'outside' end as evidence from w")
def _(spark, d):
    n = sensor(spark, d).where("subject_id = 'U02'").groupBy("device_id", "night").agg(F.min("temperature").alias("lo"), F.max("temperature").alias("hi"), F.avg("temperature").alias("m"))
    w = Window.partitionBy("device_id").orderBy("night")
    before, after = w.rangeBetween(-7, -1), w.rangeBetween(1, 7)
    x = n.withColumn("_lo", F.least(F.min("lo").over(before), F.min("lo").over(after))).withColumn("_hi", F.greatest(F.max("hi").over(before), F.max("hi").over(after))).where("_lo is not null")
    return x.select("device_id", "night", F.when(F.col("m").between(F.col("_lo"), F.col("_hi")), "within").otherwise("outside").alias("evidence"))


@query("Q05_ordinal_rows", f"with {_ORDINAL} select s.subject_id, ordinal, count(*) as n from s join o using (subject_id, night) group by 1, 2")
def _(spark, d):
    s = sensor(spark, d)
    return s.join(series.ordinals(s), ["subject_id", "night"]).groupBy("subject_id", "ordinal").agg(F.count("*").alias("n"))


@query("Q06_enriched_rows", f"with {_CTX} select row_id, night, (ts_s % 86400) // 3600 as hour, coalesce(code, 'UNKNOWN') as state, p1 + p2 + p3 + p4 + p5 + p6 > 0 as loaded from ctx")
def _(spark, d):
    return heater(spark, d).select("row_id", "night", scalars.div(F.col("ts_s") % 86_400, 3_600).alias("hour"), "state", (quality.total([F.col(c) for c in P]) > 0).alias("loaded"))


@query("R02_value_order", f"with {SENSOR} select subject_id, p1, p2, min(row_id) as first_row, count(*) as n from s group by 1, 2, 3 having count(*) > 1")
def _(spark, d):
    return sensor(spark, d).groupBy("subject_id", "p1", "p2").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n")).where("n > 1")


@query("R06_steps", f"with {_STEP} select row_id, step from st")
def _(spark, d):
    return steps(spark, d).select("row_id", "step")


@query("R08_key_values", "select 'windows' as section, unnest(['rows', 'labelled']) as metric, unnest([count(*), count(*) filter (where labelled)]) as value from windows")
def _(spark, d):
    one = table(spark, d, "windows").agg(F.count("*").alias("a"), F.count_if("labelled").alias("b"))
    return one.selectExpr("'windows' as section", "stack(2, 'rows', a, 'labelled', b) as (metric, value)")


@query("R10_dictionary", "with c as (select distinct event_raw from sensor_rows where event_raw is not null), k as (select event_raw, row_number() over (order by event_raw) - 1 as code from c) select k.event_raw, code, count(*) as n from sensor_rows join k using (event_raw) group by 1, 2")
def _(spark, d):
    c = table(spark, d, "sensor_rows").where("event_raw is not null").groupBy("event_raw").agg(F.count("*").alias("n"))
    return global_rank(c, ["event_raw"], "code").select("event_raw", "code", "n")


@query("R13_manifest", "select file_id, min(source_id) as source_id, min(relpath) as relpath, min(n_lines) as listed_lines, coalesce(max(k), 0) as found_lines from log_files f left join (select file_id, count(*) as k from raw_lines group by 1) using (file_id) group by 1")
def _(spark, d):
    f = table(spark, d, "log_files").groupBy("file_id").agg(F.min("source_id").alias("source_id"), F.min("relpath").alias("relpath"), F.min("n_lines").alias("listed_lines"))
    k = table(spark, d, "raw_lines").groupBy("file_id").agg(F.count("*").alias("k"))
    return f.join(k, "file_id", "left").select("file_id", "source_id", "relpath", "listed_lines", F.coalesce("k", F.lit(0)).alias("found_lines"))


@query("R19_metric_rows", f"with {PREDICTED} select target, seed, round(avg(abs(p - y)), 6) as mae, round(stddev_pop(p) / stddev_pop(y), 6) as q from pred group by 1, 2")
def _(spark, d):
    x = predicted(placed(spark, d)).groupBy("target", "seed")
    return x.agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"), F.round(F.try_divide(F.stddev_pop("p"), F.stddev_pop("y")), 6).alias("q"))


@query("F19_phase_ranges", f"with {SENSOR}, r as (select subject_id, file_no, min(ts_s) as lo, max(ts_s) as hi from s group by all) select r.file_no, count(*) as n from s join r on s.subject_id = r.subject_id and s.ts_s between lo and hi group by 1")
def _(spark, d):
    s = sensor(spark, d)
    r = s.groupBy("subject_id", "file_no").agg(F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi")).withColumnRenamed("file_no", "_file")
    return joins.in_range(s.select("subject_id", "ts_s"), r, ["subject_id"], "ts_s", "lo", "hi").groupBy(F.col("_file").alias("file_no")).agg(F.count("*").alias("n"))


@query("I04_boundary_key", f"with {PLACED} select md5(concat_ws('|', subject_id, device_id, segment)) as boundary, count(*) as n from placed group by 1")
def _(spark, d):
    return placed(spark, d).groupBy(F.md5(F.concat_ws("|", "subject_id", "device_id", F.col("segment").cast("string"))).alias("boundary")).agg(F.count("*").alias("n"))


@query("I16_release_view", f"with {WIN} select f.subject_id as fold, case when win.subject_id = f.subject_id then 'test' else 'train' end as part, sum(steps[1][3])::bigint as first_p1, sum(steps[8][8])::bigint as last_p6 from win, (select distinct subject_id from s) f group by 1, 2")
def _(spark, d):
    wide = made(spark, d).select("subject_id", *[F.col("steps")[i]["p"][c].alias(f"s{i}_p{c + 1}") for i in range(8) for c in range(6)])
    again = wide.select("subject_id", F.array(*[F.array(*[F.col(f"s{i}_p{c + 1}") for c in range(6)]) for i in range(8)]).alias("x"))
    return splits.held_out(again, "subject_id").groupBy("fold", "part").agg(F.sum(F.col("x")[0][0]).alias("first_p1"), F.sum(F.col("x")[7][5]).alias("last_p6"))


@query("I17_external_windows", f"with {WIN} select case when subject_id = 'U03' then 'external' else 'source' end as origin, count(*) as n, min(t0) as first_t0 from win group by 1")
def _(spark, d):
    w = made(spark, d)
    parts = [w.where(c).withColumn("origin", F.lit(n)) for n, c in (("external", "subject_id = 'U03'"), ("source", "subject_id <> 'U03'"))]
    return parts[0].unionByName(parts[1]).groupBy("origin").agg(F.count("*").alias("n"), F.min("t0").alias("first_t0"))


@query("K09_external_guard", f"with {SENSOR} select count(*) filter (where subject_id = 'U03') as external_rows, count(distinct subject_id) filter (where subject_id <> 'U03') as sources from s")
def _(spark, d):
    return sensor(spark, d).agg(F.count_if(F.col("subject_id") == "U03").alias("external_rows"), F.count_distinct(F.when(F.col("subject_id") != "U03", F.col("subject_id"))).alias("sources"))


@query("L07_boosting")
def _(spark, d):
    """Boosted trees, fitted on two subjects and scored on the third."""
    from brackwater.operators import fits

    v = sensor(spark, d).where("temperature between 1 and 59").select("subject_id", *P, F.col("temperature").cast("double").alias("y"))
    out = fits.boosted(v.where("subject_id <> 'U01'"), v.where("subject_id = 'U01'"), P, "y", rounds=5)
    return out.groupBy("subject_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 4).alias("mae"))


@query("L11_black_box", f"with {SENSOR} select subject_id, round(avg(abs(p1 / 100.0 + p2 / 200.0 - temperature)), 6) as mae from s group by 1")
def _(spark, d):
    from brackwater.operators import fits

    scored = fits.predict(sensor(spark, d).select("subject_id", "p1", "p2", "temperature"), (100.0, 200.0), lambda m, x: x["p1"] / m[0] + x["p2"] / m[1], ["p1", "p2"])
    return scored.groupBy("subject_id").agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("temperature"))), 6).alias("mae"))


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
