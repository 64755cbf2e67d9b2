"""Queries of windows and features, statistics, splits, fits, error metrics and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.functions import quality
from brackwater.operators import series as agg
from brackwater.operators import splits, stats, windows
from brackwater.plans.series import _CTX, heater
from brackwater.plans.views import PLACED, PREDICTED, SENSOR, P, placed, predicted, prediction, sensor, targets_valid
from brackwater.shared import table

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["subject_id", "device_id", "segment"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


WIN = f"""{PLACED},
sg as (select {', '.join(KEY)}, min(ts_s) as a, max(ts_s) as b from placed group by all),
wk as (select sg.*, unnest(generate_series(0, (b - 35 - a) // 20)) as k from sg where b - a >= 35),
st as (select w.subject_id, w.device_id, w.segment, k, a + 20 * k as t0, (ts_s - a - 20 * k) // 5 as bin, arg_max((ts_s, row_id, p1, p2, p3, p4, p5, p6, temperature, humidity, night), (ts_s, row_id)) as r
  from wk w join placed p on p.subject_id = w.subject_id and p.device_id = w.device_id and p.segment = w.segment and ts_s >= a + 20 * k and ts_s < a + 20 * k + 40 group by all),
win as (select subject_id, device_id, segment, k, t0, arg_max(r, bin) as last, list(r order by bin) as steps from st group by all having count(*) = 8)"""
# The tuple's fields by place: 1 ts, 2 row, 3-8 pressures, 9 temperature, 10 humidity, 11 night.


def made(spark, d) -> DataFrame:
    return windows.windows(placed(spark, d), KEY, "ts_s", "row_id", P)


def labelled(spark, d) -> DataFrame:
    """Windows with the readings of their last row."""
    target = sensor(spark, d).select(F.col("row_id").alias("target_row"), "temperature", "humidity", "night")
    return made(spark, d).join(target, "target_row")


_TARGET = "last[2] as target_row"


@query("I01_segments", f"with {PLACED} select row_id, segment from placed")
def _(spark, d):
    return placed(spark, d).select("row_id", "segment")


@query("I02_windows", f"with {WIN} select subject_id, device_id, segment, k, t0, last[1] as target_ts, last[2] as target_row from win")
def _(spark, d):
    return made(spark, d).drop("steps")


@query("I03_window_violations", f"with {WIN} select count(*) as n_windows, count(*) filter (where last[1] - t0 not between 35 and 39) as violations from win")
def _(spark, d):
    w = made(spark, d)
    inside = F.forall(F.transform("steps", lambda s, i: (s["ts"] >= F.col("t0") + i * 5) & (s["ts"] < F.col("t0") + i * 5 + 5)), lambda x: x)
    return w.agg(F.count("*").alias("n_windows"), F.count_if(~inside).alias("violations"))


@query("I05_scaled_windows", f"""with {PLACED}, sg as (select {', '.join(KEY)}, min(ts_s) as a, max(ts_s) as b from placed group by all)
select count(*) as n_windows from (select unnest(generate_series(0, (b - 75 - a) // 40)) as k from sg where b - a >= 75)""")
def _(spark, d):
    return windows.windows(placed(spark, d), KEY, "ts_s", "row_id", P, bins=16, stride_s=40).agg(F.count("*").alias("n_windows"))


@query("I06_raw_features", f"with {WIN} select {_TARGET}, round(steps[1][3] / 4095.0, 6) as first_p1, round(last[8] / 4095.0, 6) as last_p6 from win")
def _(spark, d):
    x = made(spark, d).select("target_row", windows.raw(windows.frames(F.col("steps"))).alias("x"))
    return x.select("target_row", F.round(F.col("x")[0][0], 6).alias("first_p1"), F.round(F.col("x")[7][5], 6).alias("last_p6"))


_L = "[last[3], last[4], last[5], last[6], last[7], last[8]]"


@query("I07_dominant", f"with {WIN} select {_TARGET}, case when list_max({_L}) > 0 then list_position({_L}, list_max({_L})) - 1 else -1 end as dominant from win")
def _(spark, d):
    return made(spark, d).select("target_row", quality.dominant(F.element_at("steps", -1)["p"]).alias("dominant"))


@query("I08_contact_features", f"""with {WIN}, l as (select {_TARGET}, {_L} as f, list_sum({_L})::double as t from win)
select target_row, t as total, len(list_filter(f, lambda x: x > 0))::double as active, round(case when t > 0 then list_max(f) / t else 0 end, 6) as top_share,
  round(case when t > 0 then abs(list_sum(list_transform(f, lambda x: case when x > 0 then x / t * ln(x / t) else 0 end))) / ln(6) else 0 end, 6) as entropy,
  round(sqrt(list_sum(list_transform(f, lambda x: (x - t / 6) * (x - t / 6))) / 6) / 4095, 6) as spread from l""")
def _(spark, d):
    x = made(spark, d).select("target_row", windows.contact(F.element_at("steps", -1)["p"]).alias("x"))
    c = F.col("x")
    return x.select("target_row", c[0].alias("total"), c[1].alias("active"), F.round(c[9], 6).alias("top_share"), F.round(c[8], 6).alias("entropy"), F.round(c[10], 6).alias("spread"))


@query("I09_movement_features", f"with {WIN} select {_TARGET}, (last[3] - steps[7][3])::double as d_p1, round((abs(last[3] - steps[7][3]) + abs(last[4] - steps[7][4]) + abs(last[5] - steps[7][5]) + abs(last[6] - steps[7][6]) + abs(last[7] - steps[7][7]) + abs(last[8] - steps[7][8])) / 6.0, 6) as mean_change from win")
def _(spark, d):
    x = made(spark, d).select("target_row", F.element_at(windows.movement(windows.frames(F.col("steps"))), -1).alias("x"))
    return x.select("target_row", F.col("x")[0].alias("d_p1"), F.round(F.col("x")[6], 6).alias("mean_change"))


@query("I10_feature_sizes", f"with {WIN} select len(steps) as n_steps, 6 + 11 + 10 as n_features, count(*) as n_windows from win group by 1")
def _(spark, d):
    f = windows.frames(F.col("steps"))
    both = F.zip_with(F.zip_with(windows.raw(f), F.transform(f, lambda x: windows.contact(x)), lambda a, b: F.concat(a, b)), windows.movement(f), lambda a, b: F.concat(a, b).cast("array<float>"))
    x = made(spark, d).select(both.alias("x"))
    return x.groupBy(F.size("x").cast("long").alias("n_steps"), F.size(F.col("x")[0]).cast("long").alias("n_features")).agg(F.count("*").alias("n_windows"))


@query("I11_history_features", f"""with {WIN}, l as (select {_TARGET}, c as channel, list_transform(steps, lambda s: [s[3], s[4], s[5], s[6], s[7], s[8]][c + 1]) as x from win, (select unnest(generate_series(0, 5)) as c))
select target_row, channel, round(list_avg(x), 6) as mean, round(list_stddev_pop(x), 6) as sd, list_min(x) as low, list_max(x) as high, x[8] as last, x[8] - x[1] as net,
  abs(x[2] - x[1]) + abs(x[3] - x[2]) + abs(x[4] - x[3]) + abs(x[5] - x[4]) + abs(x[6] - x[5]) + abs(x[7] - x[6]) + abs(x[8] - x[7]) as variation from l""")
def _(spark, d):
    h = windows.history(made(spark, d), ["target_row"], "ts_s", P)
    return h.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6), "channel": F.col("channel").cast("long")})


@query("I12_history_available", f"with {WIN} select {_TARGET}, h as history_s, t0 + 40 - h >= a as available, case when t0 + 40 - h >= a then '' when segment = 1 then 'session_start' else 'gap' end as reason from win join sg using (subject_id, device_id, segment), (values (40), (60), (100)) v(h)")
def _(spark, d):
    w = made(spark, d).withColumn("history_s", F.explode(F.array(*[F.lit(x) for x in (40, 60, 100)])))
    start = placed(spark, d).groupBy(*KEY).agg(F.min("ts_s").alias("a"))
    ok = F.col("t0") + 40 - F.col("history_s") >= F.col("a")
    return w.join(start, KEY).select("target_row", "history_s", ok.alias("available"), F.when(ok, "").when(F.col("segment") == 1, "session_start").otherwise("gap").alias("reason"))


@query("I13_fold_windows", f"with {WIN} select f.subject_id as fold, case when w.subject_id = f.subject_id then 'test' else 'train' end as part, count(*) as n, count(*) filter (where last[9] between 1 and 59) as labelled from win w, (select distinct subject_id from s) f group by 1, 2")
def _(spark, d):
    return splits.held_out(labelled(spark, d), "subject_id").groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_if(F.col("temperature").between(1, 59)).alias("labelled"))


@query("I15_release_table", f"with {WIN}, a as (select subject_id, min(night) as first_night from s group by 1) select {_TARGET}, last[11] - first_night + 1 as night_no, t0 - first_night * 86400 as start_rel, steps[1][3] as s0_p1, last[8] as s7_p6 from win join a using (subject_id)")
def _(spark, d):
    w = labelled(spark, d)
    first = sensor(spark, d).groupBy("subject_id").agg(F.min("night").alias("_n"))
    flat = [F.col("steps")[i]["p"][c].alias(f"s{i}_p{c + 1}") for i in range(8) for c in range(6)]
    wide = w.join(first, "subject_id").select("target_row", (F.col("night") - F.col("_n") + 1).alias("night_no"), (F.col("t0") - F.col("_n") * 86_400).alias("start_rel"), *flat)
    return wide.select("target_row", "night_no", "start_rel", "s0_p1", "s7_p6")


@query("I18_descriptors", f"with {SENSOR} select row_id, p1 + p2 + p3 + p4 + p5 + p6 as total, round((p1 + p2 + p3 + p4 + p5 + p6) / 6.0, 6) as mean, (p1 = 4095)::int + (p2 = 4095)::int + (p3 = 4095)::int + (p4 = 4095)::int + (p5 = 4095)::int + (p6 = 4095)::int as at_bound, case when p1 + p2 + p3 + p4 + p5 + p6 > 0 then round(p1 / (p1 + p2 + p3 + p4 + p5 + p6), 6) end as share_p1 from s")
def _(spark, d):
    p = [F.col(c) for c in P]
    t = quality.total(p)
    return sensor(spark, d).select("row_id", t.alias("total"), F.round(t / 6.0, 6).alias("mean"), quality.at_bound(p).alias("at_bound"), F.when(t > 0, F.round(F.try_divide("p1", t), 6)).alias("share_p1"))


@query("J01_pearson", "select l_returnflag, case when count(*) >= 3 then round(corr(l_quantity, l_extendedprice), 6) end as r from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(agg.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


def _rank(x: str, keys: str = "") -> str:
    part = f"partition by {keys}" if keys else ""
    both = f"partition by {keys}, {x}" if keys else f"partition by {x}"
    return f"(rank() over ({part} order by {x}) + (count(*) over ({both}) - 1) / 2.0)"


@query("J02_spearman", f"with r as (select l_returnflag, {_rank('l_quantity', 'l_returnflag')} as a, {_rank('l_extendedprice', 'l_returnflag')} as b from lineitem) select l_returnflag, count(*) as n, round(corr(a, b), 6) as rho from r group by 1")
def _(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("J03_channel_correlation", f"with {SENSOR} " + " union all ".join(f"select 'p{i}' as a, 'p{j}' as b, round(corr(p{i}, p{j}), 6) as r from s" for i in range(1, 7) for j in range(i + 1, 7)))
def _(spark, d):
    pairs = [(f"p{i}", f"p{j}") for i in range(1, 7) for j in range(i + 1, 7)]
    one = sensor(spark, d).agg(*[F.round(agg.pearson(F.col(a), F.col(b)), 6).alias(f"{a}{b}") for a, b in pairs])
    return one.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', {a}{b}" for a, b in pairs) + ") as (a, b, r)")


@query("J04_shift_whole_numbers", f"""with {SENSOR}, c as (select subject_id, temperature as v, count(*) filter (where night % 2 = 0) as a, count(*) filter (where night % 2 = 1) as b from s group by all),
f as (select *, abs(sum(a) over w / sum(a) over (partition by subject_id) - sum(b) over w / sum(b) over (partition by subject_id)) as d, lead(v) over (partition by subject_id order by v) - v as gap from c window w as (partition by subject_id order by v rows unbounded preceding))
select subject_id, sum(a)::bigint as n_a, sum(b)::bigint as n_b, round(sum(d * gap), 6) as w1, round(max(d), 6) as ks from f group by 1""")
def _(spark, d):
    return stats.distribution_shift(sensor(spark, d), ["subject_id"], "temperature", F.col("night") % 2 == 1)


_GRID = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"


@query("J05_shift_quantiles", f"with q as (select l_returnflag, quantile_cont(l_extendedprice, {_GRID}) filter (where l_quantity < 25) as a, quantile_cont(l_extendedprice, {_GRID}) filter (where l_quantity >= 25) as b from lineitem group by 1) select l_returnflag, round(list_avg(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 3) as w1 from q")
def _(spark, d):
    grid = F.array(*[F.lit(i / 100) for i in range(101)])
    q = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.percentile(F.when(c, F.col("l_extendedprice")), grid).alias(n) for n, c in (("a", F.col("l_quantity") < 25), ("b", F.col("l_quantity") >= 25))])
    total = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return q.select("l_returnflag", F.round(total / 101, 3).alias("w1"))


@query("J07_robust_difference", f"with {SENSOR}, q as (select subject_id, quantile_cont(p1, 0.5) filter (where night % 2 = 0) as ma, quantile_cont(p1, 0.5) filter (where night % 2 = 1) as mb, quantile_cont(p1, 0.75) filter (where night % 2 = 0) - quantile_cont(p1, 0.25) filter (where night % 2 = 0) as ia, quantile_cont(p1, 0.75) filter (where night % 2 = 1) - quantile_cont(p1, 0.25) filter (where night % 2 = 1) as ib from s group by 1) select subject_id, ma, mb, round((mb - ma) / sqrt((pow(ia / 1.349, 2) + pow(ib / 1.349, 2)) / 2), 6) as robust_sd from q")
def _(spark, d):
    return stats.robust_difference(sensor(spark, d), ["subject_id"], "p1", F.col("night") % 2 == 1)


@query("J08_cliffs_delta", f"with {SENSOR}, r as (select subject_id, night % 2 = 1 as b, {_rank('p1', 'subject_id')} as rk from s), g as (select subject_id, count(*) filter (where b) as nb, count(*) filter (where not b) as na, sum(rk) filter (where b) as rb from r group by 1) select subject_id, round(2 * (rb - nb * (nb + 1) / 2.0) / (na * nb) - 1, 6) as delta from g")
def _(spark, d):
    return stats.cliffs_delta(sensor(spark, d), ["subject_id"], "p1", F.col("night") % 2 == 1)


@query("J09_before_after", f"with {SENSOR}, u as (select subject_id, night % 2 = 1 as b, unnest(['temperature', 'humidity']) as metric, unnest([temperature, humidity]) as x from s) select metric, quantile_cont(x, 0.5) filter (where not b) as before_median, quantile_cont(x, 0.5) filter (where b) as after_median, min(x) as low, max(x) as high from u group by 1")
def _(spark, d):
    u = sensor(spark, d).select((F.col("night") % 2 == 1).alias("b"), "temperature", "humidity").unpivot(["b"], ["temperature", "humidity"], "metric", "x")
    half = lambda c, n: F.percentile(F.when(c, F.col("x")), 0.5).alias(n)
    return u.groupBy("metric").agg(half(~F.col("b"), "before_median"), half(F.col("b"), "after_median"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("J10_agreement", f"with {SENSOR}, t as (select subject_id, avg((p4 > 0)::int::double) as a, avg((p5 > 0)::int::double) as b, avg((p4 > 0 and p5 > 0)::int::double) as joint, avg(((p4 > 0) = (p5 > 0))::int::double) as agree from s group by 1) select subject_id, round(agree, 6) as agreement, round((agree - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) as kappa, round(joint / b, 6) as a_given_b from t")
def _(spark, d):
    x, y = F.col("p4") > 0, F.col("p5") > 0
    share = lambda c, n: F.avg(c.cast("int")).alias(n)
    t = sensor(spark, d).groupBy("subject_id").agg(share(x, "a"), share(y, "b"), share(x & y, "both"), share(x == y, "agree"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return t.select("subject_id", F.round("agree", 6).alias("agreement"), F.round(F.try_divide(F.col("agree") - chance, 1 - chance), 6).alias("kappa"), F.round(F.try_divide("both", "b"), 6).alias("a_given_b"))


@query("J11_differences", f"with {SENSOR} select subject_id, quantile_cont(temperature - humidity, 0.5) as median, round(avg(abs(temperature - humidity)), 6) as mae, quantile_cont(temperature - humidity, 0.95) as q95 from s group by 1")
def _(spark, d):
    x = F.col("temperature") - F.col("humidity")
    return sensor(spark, d).groupBy("subject_id").agg(F.percentile(x, 0.5).alias("median"), F.round(F.avg(F.abs(x)), 6).alias("mae"), F.percentile(x, 0.95).alias("q95"))


@query("J12_eta_squared", f"with {_CTX}, g as (select subject_id, coalesce(code, 'UNKNOWN') as st, count(*) as n, avg(temperature) as m from ctx group by all), t as (select subject_id, avg(temperature) as gm, sum(pow(temperature, 2)) - count(*) * pow(avg(temperature), 2) as total from ctx group by 1) select subject_id, case when count(*) >= 2 and any_value(total) > 0 then round(sum(n * pow(m - gm, 2)) / any_value(total), 6) end as eta2 from g join t using (subject_id) group by 1")
def _(spark, d):
    return stats.eta_squared(heater(spark, d), ["subject_id"], "state", "temperature")


@query("J13_centred", f"with {SENSOR} select row_id, round(temperature - avg(temperature) over (partition by subject_id, night), 6) as centred from s")
def _(spark, d):
    s = sensor(spark, d)
    m = s.groupBy("subject_id", "night").agg(F.avg("temperature").alias("_m"))
    return s.join(m, ["subject_id", "night"]).select("row_id", F.round(F.col("temperature") - F.col("_m"), 6).alias("centred"))


@query("J14_signal", f"with {PREDICTED} select subject_id, seed, target, round(stddev_pop(p - y) / stddev_pop(y), 6) as r_error, round(stddev_pop(p) / stddev_pop(y), 6) as q, round(corr(p, y), 6) as r from pred group by 1, 2, 3")
def _(spark, d):
    return predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(*stats.signal(F.col("y"), F.col("p")))


@query("J15_night_correlations", f"with {PREDICTED}, n as (select subject_id, target, night, count(*) as n, corr(p, y) as r from pred where seed = 0 group by all) select subject_id, target, round(quantile_cont(r, 0.5) filter (where n >= 10), 6) as median_r, count(*) filter (where n < 10) as too_few, count(*) as nights from n group by 1, 2")
def _(spark, d):
    n = predicted(placed(spark, d)).where("seed = 0").groupBy("subject_id", "target", "night").agg(F.count("*").alias("n"), agg.pearson(F.col("p"), F.col("y")).alias("r"))
    return n.groupBy("subject_id", "target").agg(F.round(F.percentile(F.when(F.col("n") >= 10, F.col("r")), 0.5), 6).alias("median_r"), F.count_if(F.col("n") < 10).alias("too_few"), F.count("*").alias("nights"))


@query("J16_residuals", f"with {PREDICTED} select subject_id, target, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg(pow(p - y, 2))), 6) as rmse, round(avg(p - y), 6) as bias, round(sqrt(greatest(avg(pow(p - y, 2)) - pow(avg(p - y), 2), 0)), 6) as error_sd from pred where seed = 1 group by 1, 2")
def _(spark, d):
    e = (F.col("p") - F.col("y")).cast("double")
    g = predicted(placed(spark, d)).where("seed = 1").groupBy("subject_id", "target").agg(F.avg(F.abs(e)).alias("a"), F.avg(e * e).alias("s"), F.avg(e).alias("b"))
    return g.select("subject_id", "target", F.round("a", 6).alias("mae"), F.round(F.sqrt("s"), 6).alias("rmse"), F.round("b", 6).alias("bias"), F.round(F.sqrt(F.greatest(F.col("s") - F.col("b") * F.col("b"), F.lit(0.0))), 6).alias("error_sd"))


@query("J17_pressure_target", f"with {SENSOR}, n as (select subject_id, night, quantile_cont(p1, 0.5) as x, quantile_cont(temperature, 0.5) as y from s group by all), r as (select subject_id, {_rank('x', 'subject_id')} as a, {_rank('y', 'subject_id')} as b from n) select subject_id, count(*) as n, round(corr(a, b), 6) as rho from r group by 1")
def _(spark, d):
    n = sensor(spark, d).groupBy("subject_id", "night").agg(F.percentile("p1", 0.5).alias("x"), F.percentile("temperature", 0.5).alias("y"))
    return stats.spearman(n, ["subject_id"], "x", "y")


def sessions_of(spark, d) -> DataFrame:
    return placed(spark, d).select("subject_id", "device_id", "session").distinct()


_SES = f"{PLACED}, ses as (select distinct subject_id, device_id, session from placed), folds as (select distinct subject_id as fold from ses)"


@query("K01_outer_folds", f"with {_SES} select ses.*, fold, case when subject_id = fold then 'test' else 'train' end as part from ses, folds")
def _(spark, d):
    return splits.held_out(sessions_of(spark, d), "subject_id")


@query("K02_inner_folds", f"with {_SES} select ses.*, f.fold, v.fold as validated, case when subject_id = v.fold then 'validate' else 'train' end as role from ses, folds f, folds v where subject_id <> f.fold and v.fold <> f.fold")
def _(spark, d):
    return splits.inner_swaps(sessions_of(spark, d), "subject_id")


_ORDINAL = f"{SENSOR}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s)"
_PART = "case when budget = 0 then 'test' when ordinal <= budget then 'adapt' when ordinal = budget + 1 then 'buffer' else 'test' end"


@query("K03_budgets", f"with {_ORDINAL}, b as (select *, {_PART} as part from o, (values (0), (1), (3), (7), (14)) v(budget)) select subject_id, night, ordinal, budget, part, part = 'test' and ordinal >= 16 as is_primary from b")
def _(spark, d):
    return splits.chronological(agg.ordinals(sensor(spark, d)), [0, 1, 3, 7, 14])


@query("K05_split_checks", f"""with {_SES}{_ORDINAL[len(SENSOR):]}, k as (select ses.*, fold, case when subject_id = fold then 'test' else 'train' end as part from ses, folds),
b as (select *, {_PART} as part from o, (values (0), (1), (3), (7), (14)) v(budget)),
sp as (select subject_id, budget, max(night) filter (where part = 'adapt') as a, min(night) filter (where part = 'test') as t from b group by 1, 2)
select 'held_out_only_tests' as check_name, count(*) as violations from k where (subject_id = fold) <> (part = 'test')
union all select 'session_once', count(*) from (select fold, subject_id, device_id, session from k group by all having count(distinct part) > 1)
union all select 'adapt_before_test', count(*) from sp where a >= t
union all select 'primary_equal', count(*) from (select subject_id, night from b where part = 'test' and ordinal >= 16 group by all having count(*) <> 5)""")
def _(spark, d):
    outer = Q["K01_outer_folds"](spark, d)
    budgets = Q["K03_budgets"](spark, d)
    spans = budgets.groupBy("subject_id", "budget").agg(F.max(F.when(F.col("part") == "adapt", F.col("night"))).alias("a"), F.min(F.when(F.col("part") == "test", F.col("night"))).alias("t"))
    primary = budgets.where("is_primary").groupBy("subject_id", "night").agg(F.count("*").alias("n"))
    return splits.gate({
        "held_out_only_tests": lambda: outer.where((F.col("subject_id") == F.col("fold")) != (F.col("part") == "test")),
        "session_once": lambda: outer.groupBy("fold", "subject_id", "device_id", "session").agg(F.count_distinct("part").alias("k")).where("k > 1"),
        "adapt_before_test": lambda: spans.where("a >= t"),
        "primary_equal": lambda: primary.where("n <> 5"),
    })


@query("K06_coverage_checks", f"with {_SES}, sp as (select * from ses where session % 7 <> 0) select count(*) filter (where sp.session is null) as unassigned, count(*) filter (where ses.session is null) as unknown_sessions from ses full join sp on ses.subject_id = sp.subject_id and ses.device_id = sp.device_id and ses.session = sp.session")
def _(spark, d):
    ses = sessions_of(spark, d)
    both = ses.withColumn("_a", F.lit(1)).join(ses.where("session % 7 <> 0").withColumn("_b", F.lit(1)), ["subject_id", "device_id", "session"], "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("unassigned"), F.count_if(F.col("_a").isNull()).alias("unknown_sessions"))


@query("K08_fit_windows", f"with {_ORDINAL}, b as (select *, {_PART} as part from o, (values (3), (7)) v(budget)) select budget, part, count(*) as rows_in from s join b using (subject_id, night) group by 1, 2")
def _(spark, d):
    b = splits.chronological(agg.ordinals(sensor(spark, d)), [3, 7])
    return sensor(spark, d).join(b, ["subject_id", "night"]).groupBy("budget", "part").agg(F.count("*").alias("rows_in"))


@query("K11_source_only", f"with {SENSOR} select fold, count(*) filter (where subject_id = fold) as leaked, count(distinct subject_id) as sources from s, (select distinct subject_id as fold from s) f where subject_id <> fold group by 1")
def _(spark, d):
    train = splits.held_out(sensor(spark, d).select("subject_id"), "subject_id").where("part = 'train'")
    return train.groupBy("fold").agg(F.count_if(F.col("subject_id") == F.col("fold")).alias("leaked"), F.count_distinct("subject_id").alias("sources"))


@query("K13_eligibility", f"with {SENSOR} select subject_id, case when count(distinct night) < 10 then 'no' when avg((temperature between 1 and 59)::int) < 0.99 then 'with_caveat' else 'eligible' end as eligibility from s group by 1")
def _(spark, d):
    g = sensor(spark, d).groupBy("subject_id").agg(F.count_distinct("night").alias("k"), F.avg(F.col("temperature").between(1, 59).cast("int")).alias("v"))
    return g.select("subject_id", F.when(F.col("k") < 10, "no").when(F.col("v") < 0.99, "with_caveat").otherwise("eligible").alias("eligibility"))


@query("K14_key_digest", f"with {_ORDINAL}, b as (select *, {_PART} as part from o, (values (0), (1), (3), (7), (14)) v(budget)) select budget, sha256(string_agg(subject_id || '|' || night::varchar, chr(10) order by subject_id || '|' || night::varchar)) as digest from b where part = 'test' and ordinal >= 16 group by budget")
def _(spark, d):
    keys = Q["K03_budgets"](spark, d).where("is_primary").select("budget", F.concat_ws("|", "subject_id", F.col("night").cast("string")).alias("k"))
    # One key a night and subject: the list is bounded by the calendar.
    return keys.groupBy("budget").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("digest"))


@query("L01_constants", f"with {SENSOR}, v as (select * from s where temperature between 1 and 59) select fold, round(avg(temperature), 6) as mean, quantile_cont(temperature, 0.5) as median from v, (select distinct subject_id as fold from s) f where subject_id <> fold group by 1")
def _(spark, d):
    v = sensor(spark, d).where("temperature between 1 and 59").select("subject_id", "temperature")
    return splits.held_out(v, "subject_id").where("part = 'train'").groupBy("fold").agg(F.round(F.avg("temperature"), 6).alias("mean"), F.percentile("temperature", 0.5).alias("median"))


@query("L02_scaler", f"with {SENSOR}, m as (select subject_id, avg(temperature) as m, stddev_pop(temperature) as sd from s group by 1) select row_id, round((temperature - m) / sd, 6) as z from s join m using (subject_id)")
def _(spark, d):
    s = sensor(spark, d)
    m = s.groupBy("subject_id").agg(F.avg("temperature").alias("m"), F.stddev_pop("temperature").alias("sd"))
    return s.join(m, "subject_id").select("row_id", F.round(F.try_divide(F.col("temperature") - F.col("m"), F.col("sd")), 6).alias("z"))


@query("L03_offset", f"with {PREDICTED}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s), c as (select subject_id, seed, target, avg(y - p) as offs from pred join o using (subject_id, night) where ordinal <= 7 group by all) select subject_id, seed, target, round(any_value(offs), 6) as offs, round(avg(abs(p + offs - y)), 6) as mae from pred join o using (subject_id, night) join c using (subject_id, seed, target) where ordinal > 8 group by 1, 2, 3")
def _(spark, d):
    rows = placed(spark, d)
    x = predicted(rows).join(agg.ordinals(rows), ["subject_id", "night"])
    keys = ["subject_id", "seed", "target"]
    c = x.where("ordinal <= 7").groupBy(*keys).agg(F.avg(F.col("y") - F.col("p")).alias("offs"))
    return x.where("ordinal > 8").join(c, keys).groupBy(*keys).agg(F.round(F.first("offs"), 6).alias("offs"), F.round(F.avg(F.abs(F.col("p") + F.col("offs") - F.col("y"))), 6).alias("mae"))


@query("L04_affine", f"with {PREDICTED} select subject_id, seed, target, round(coalesce(regr_slope(y, p), 0), 6) as slope, round(avg(y) - coalesce(regr_slope(y, p), 0) * avg(p), 6) as intercept from pred group by 1, 2, 3")
def _(spark, d):
    return predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(*stats.least_squares(F.col("y"), F.col("p")))


@query("L05_conditioned", f"with {_CTX}, m as (select coalesce(code, 'UNKNOWN') as state, avg(temperature) as m from ctx where subject_id <> 'U01' group by 1), t as (select avg(temperature) as m from ctx where subject_id <> 'U01') select state, round(case when state = 'UNKNOWN' then t.m else coalesce(m.m, t.m) end, 6) as prediction from (values ('ON'), ('OFF'), ('UNKNOWN'), ('NEVER')) v(state) left join m using (state), t")
def _(spark, d):
    c = heater(spark, d).where("subject_id <> 'U01'")
    whole = c.agg(F.avg("temperature")).scalar()
    states = spark.createDataFrame([("ON",), ("OFF",), ("UNKNOWN",), ("NEVER",)], "state string")
    by = states.join(c.groupBy("state").agg(F.avg("temperature").alias("_m")), "state", "left").withColumn("_t", whole)
    return by.select("state", F.round(F.when(F.col("state") == "UNKNOWN", F.col("_t")).otherwise(F.coalesce("_m", "_t")), 6).alias("prediction"))


@query("L06_ridge")
def _(spark, d):
    v = sensor(spark, d).where("temperature between 1 and 59")
    return stats.ridge(v, ["subject_id"], P, "temperature", 10.0)


@query("L08_selection", f"with {PREDICTED}, c as (select subject_id, seed, avg(abs(p - y)) as crit from pred where target = 'temperature' group by 1, 2) select subject_id, arg_min(seed, (round(crit, 9), seed)) as config from c group by 1")
def _(spark, d):
    c = predicted(placed(spark, d)).where("target = 'temperature'").groupBy("subject_id", "seed").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("crit"))
    return c.groupBy("subject_id").agg(F.min_by("seed", F.struct(F.round("crit", 9), "seed")).alias("config"))


@query("L09_best_epoch", "with e as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as epoch, o_totalprice as loss from orders) select o_custkey, arg_min(epoch, (loss, epoch)) as best_epoch, count(*) as epochs from e group by 1")
def _(spark, d):
    e = table(spark, d, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("epoch"), F.col("o_totalprice").alias("loss"))
    return e.groupBy("o_custkey").agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.count("*").alias("epochs"))


_ERR = "count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg(pow(p - y, 2))), 6) as rmse, round(avg(p - y), 6) as bias"


@query("M01_errors", f"with {PREDICTED} select subject_id, seed, target, {_ERR} from pred group by 1, 2, 3")
def _(spark, d):
    return predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(*stats.errors(F.col("y"), F.col("p")))


@query("M02_subject_mean", f"with {PREDICTED}, m as (select subject_id, seed, target, avg(abs(p - y)) as mae from pred group by all) select seed, target, count(*) as subjects, round(avg(mae), 6) as mae from m group by 1, 2")
def _(spark, d):
    m = predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    return m.groupBy("seed", "target").agg(F.count("*").alias("subjects"), F.round(F.avg("mae"), 6).alias("mae"))


@query("M03_spans", f"with {PREDICTED}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s), x as (select *, unnest([case when ordinal >= 2 then 'later' end, case when ordinal >= 16 then 'primary' end]) as span from pred join o using (subject_id, night)) select subject_id, target, span, {_ERR} from x where span is not null and seed = 0 group by 1, 2, 3")
def _(spark, d):
    rows = placed(spark, d)
    x = predicted(rows).where("seed = 0").join(agg.ordinals(rows), ["subject_id", "night"])
    span = F.explode(F.array_compact(F.array(F.when(F.col("ordinal") >= 2, "later"), F.when(F.col("ordinal") >= 16, "primary"))))
    return x.withColumn("span", span).groupBy("subject_id", "target", "span").agg(*stats.errors(F.col("y"), F.col("p")))


@query("M04_per_night", f"with {PREDICTED} select subject_id, night, seed, target, {_ERR} from pred group by 1, 2, 3, 4")
def _(spark, d):
    return predicted(placed(spark, d)).groupBy("subject_id", "night", "seed", "target").agg(*stats.errors(F.col("y"), F.col("p")))


@query("M05_strata", f"with {PREDICTED} select coalesce(subject_id, 'ALL') as subject_id, coalesce(device_id, 'ALL') as device_id, target, {_ERR} from pred where seed = 0 group by grouping sets ((target), (subject_id, target), (subject_id, device_id, target))")
def _(spark, d):
    x = predicted(placed(spark, d)).where("seed = 0").select("subject_id", "device_id", "target", "y", "p")
    sets = [["target"], ["subject_id", "target"], ["subject_id", "device_id", "target"]]
    g = x.groupingSets(sets, "subject_id", "device_id", "target").agg(*stats.errors(F.col("y"), F.col("p")))
    return g.withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ("subject_id", "device_id")})


@query("M06_seed_spread", f"with {PREDICTED}, m as (select subject_id, seed, target, avg(abs(p - y)) as mae from pred group by all) select subject_id, target, round(avg(mae), 6) as mean, round(stddev_samp(mae), 6) as sd, round(min(mae), 6) as low, round(max(mae), 6) as high from m group by 1, 2")
def _(spark, d):
    m = predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    return m.groupBy("subject_id", "target").agg(*[F.round(f("mae"), 6).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("low", F.min), ("high", F.max))])


@query("M07_pooled", f"with {PREDICTED} select seed, target, {_ERR} from pred group by 1, 2")
def _(spark, d):
    return predicted(placed(spark, d)).groupBy("seed", "target").agg(*stats.errors(F.col("y"), F.col("p")))


@query("M08_comparison", f"with {PREDICTED}, m as (select subject_id, seed, target, avg(abs(p - y)) as mae from pred group by all) select a.subject_id, a.target, a.seed, round(a.mae - b.mae, 6) as delta, rank() over (partition by a.subject_id, a.target order by round(a.mae, 9)) as place from m a join m b on b.subject_id = a.subject_id and b.target = a.target and b.seed = 0")
def _(spark, d):
    m = predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    base = m.where("seed = 0").select("subject_id", "target", F.col("mae").alias("_b"))
    return m.join(base, ["subject_id", "target"]).select("subject_id", "target", "seed", F.round(F.col("mae") - F.col("_b"), 6).alias("delta"), F.rank().over(Window.partitionBy("subject_id", "target").orderBy(F.round("mae", 9))).alias("place"))


@query("M09_gain", f"with {PREDICTED}, m as (select subject_id, seed, target, avg(abs(p - y)) as mae from pred group by all) select a.subject_id, a.target, a.seed, round((b.mae - a.mae) / b.mae * 100, 6) as gain from m a join m b on b.subject_id = a.subject_id and b.target = a.target and b.seed = 0 where a.seed > 0")
def _(spark, d):
    m = predicted(placed(spark, d)).groupBy("subject_id", "seed", "target").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    base = m.where("seed = 0").select("subject_id", "target", F.col("mae").alias("_b"))
    return m.where("seed > 0").join(base, ["subject_id", "target"]).select("subject_id", "target", "seed", F.round(F.try_divide(F.col("_b") - F.col("mae"), F.col("_b")) * 100, 6).alias("gain"))


@query("M10_drift", f"with {PREDICTED}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s) select subject_id, target, first_night, round(avg(abs(p - y)), 6) as mae from pred join o using (subject_id, night), (values (12), (16), (21)) v(first_night) where seed = 0 and ordinal >= first_night group by 1, 2, 3")
def _(spark, d):
    rows = placed(spark, d)
    x = predicted(rows).where("seed = 0").join(agg.ordinals(rows), ["subject_id", "night"]).withColumn("first_night", F.explode(F.array(*[F.lit(k) for k in (12, 16, 21)])))
    return x.where("ordinal >= first_night").groupBy("subject_id", "target", "first_night").agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"))


@query("M13_consistency", f"with {PREDICTED}, a as (select subject_id, target, avg(abs(p - y)) as mae from pred where seed = 0 group by all), n as (select subject_id, target, night, count(*) as n, avg(abs(p - y)) as mae from pred where seed = 0 group by all), b as (select subject_id, target, sum(n * mae) / sum(n) as mae from n group by all) select count(*) as cells, count(*) filter (where abs(a.mae - b.mae) > 1e-9) as differing from a join b using (subject_id, target)")
def _(spark, d):
    x = predicted(placed(spark, d)).where("seed = 0")
    mae = F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")
    n = x.groupBy("subject_id", "target", "night").agg(F.count("*").alias("n"), mae)
    b = n.groupBy("subject_id", "target").agg((F.sum(F.col("n") * F.col("mae")) / F.sum("n")).alias("_b"))
    return x.groupBy("subject_id", "target").agg(mae).join(b, ["subject_id", "target"]).agg(F.count("*").alias("cells"), F.count_if(F.abs(F.col("mae") - F.col("_b")) > 1e-9).alias("differing"))


@query("M14_by_context", f"with {_CTX}, x as (select coalesce(code, 'UNKNOWN') as state, abs(24 + (row_id * 7) % 9 - temperature) as e from ctx) select coalesce(state, 'ALL') as state, count(*) as n, round(avg(e), 6) as mae from x group by rollup (state)")
def _(spark, d):
    x = heater(spark, d).select("state", F.abs(24 + (F.col("row_id") * 7) % 9 - F.col("temperature")).alias("e"))
    return x.rollup("state").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mae")).withColumn("state", F.coalesce("state", F.lit("ALL")))


@query("M16_level_baselines", f"with {PREDICTED}, c as (select subject_id, target, quantile_cont(y, 0.5) as med, avg(y) as mean from pred where seed = 0 group by all) select subject_id, target, round(avg(abs(mean - y)), 6) as mae_mean, round(avg(abs(med - y)), 6) as mae_median, round(avg(abs(p - y)), 6) as mae_model from pred join c using (subject_id, target) where seed = 0 group by 1, 2")
def _(spark, d):
    x = predicted(placed(spark, d)).where("seed = 0").select("subject_id", "target", "y", "p")
    c = x.groupBy("subject_id", "target").agg(F.percentile("y", 0.5).alias("_med"), F.avg("y").alias("_mean"))
    err = lambda a, n: F.round(F.avg(F.abs(F.col(a) - F.col("y"))), 6).alias(n)
    return x.join(c, ["subject_id", "target"]).groupBy("subject_id", "target").agg(err("_mean", "mae_mean"), err("_med", "mae_median"), err("p", "mae_model"))


RESAMPLES = 200
_BOOT = f"""{PREDICTED}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s),
part as (select subject_id, target, ordinal, sum(abs(p - y)) filter (where seed = 0) as a, sum(abs(p - y)) filter (where seed = 1) as b, count(*) filter (where seed = 0) as n from pred join o using (subject_id, night) group by all),
k as (select subject_id, max(ordinal) as n from o group by 1),
dr as (select subject_id, r as resample, (r * 7919 + j * 104729 + (r * j) % 8191 * 31) % n + 1 as ordinal, count(*) as times from k, (select unnest(generate_series(0, {RESAMPLES - 1})) as r), lateral (select unnest(generate_series(0, n - 1)) as j) group by all),
boot as (select subject_id, target, resample, sum(times * a) / sum(times * part.n) as mae_a, sum(times * b) / sum(times * part.n) as mae_b from dr join part using (subject_id, ordinal) group by all)"""


def numbered(rows: DataFrame) -> DataFrame:
    """Each subject's nights with their ordinals and their number."""
    return agg.ordinals(rows).withColumn("nights", F.max("ordinal").over(Window.partitionBy("subject_id")))


def bootstrap(spark, d, resamples: int = RESAMPLES) -> DataFrame:
    """Both predictors' errors a resample: every reading is read once and summed into its night; nights without valid readings count."""
    error = lambda target, seed: F.sum(F.when(targets_valid(), F.abs(prediction(target, seed) - F.col(target))))
    sums = [error(target, seed).alias(f"{target}_{seed}") for target in ("temperature", "humidity") for seed in (0, 1)]
    own = Window.partitionBy("subject_id")
    nights = sensor(spark, d).groupBy("subject_id", "night").agg(F.count_if(targets_valid()).alias("n"), *sums)
    nights = nights.select("*", F.row_number().over(own.orderBy("night")).alias("ordinal"), F.count("*").over(own).alias("nights")).where("n > 0")
    part = nights.selectExpr("subject_id", "nights", "ordinal", "n", "stack(2, 'temperature', temperature_0, temperature_1, 'humidity', humidity_0, humidity_1) as (target, a, b)")
    w = stats.resampled_sums(part, "target", ["n", "a", "b"], resamples)
    return w.select("subject_id", "target", "resample", (F.col("a") / F.col("n")).alias("mae_a"), (F.col("b") / F.col("n")).alias("mae_b"))


@query("N01_draws", f"with {_BOOT} select * from dr")
def _(spark, d, resamples=RESAMPLES):
    o = agg.ordinals(sensor(spark, d))
    return stats.draws(o.groupBy("subject_id").agg(F.max("ordinal").cast("long").alias("n")), resamples)


@query("N02_resampled_errors", f"with {_BOOT} select subject_id, target, resample, round(mae_a, 6) as mae_a, round(mae_b, 6) as mae_b from boot")
def _(spark, d, resamples=RESAMPLES):
    return bootstrap(spark, d, resamples).withColumns({"mae_a": F.round("mae_a", 6), "mae_b": F.round("mae_b", 6)})


_SIDE = "case when lo > 0 then 'above_zero' when hi < 0 then 'below_zero' else 'includes_zero' end as side"


@query("N04_paired_bootstrap", f"with {_BOOT}, q as (select subject_id, target, round(quantile_cont(mae_b - mae_a, 0.025), 6) as lo, round(quantile_cont(mae_b - mae_a, 0.975), 6) as hi from boot group by 1, 2) select *, {_SIDE} from q")
def _(spark, d, resamples=RESAMPLES):
    x = F.col("mae_b") - F.col("mae_a")
    q = bootstrap(spark, d, resamples).groupBy("subject_id", "target").agg(F.round(F.percentile(x, 0.025), 6).alias("lo"), F.round(F.percentile(x, 0.975), 6).alias("hi"))
    return q.withColumn("side", stats.side(F.col("lo"), F.col("hi")))


@query("N05_correlation_bootstrap", f"""with {_BOOT}, m as (select subject_id, target, ordinal, count(*) as n, sum(p) as sp, sum(y) as sy, sum(p * p) as spp, sum(y * y) as syy, sum(p * y) as spy from pred join o using (subject_id, night) where seed = 0 group by all),
w as (select subject_id, target, resample, sum(times * m.n)::double as n, sum(times * sp)::double as sp, sum(times * sy)::double as sy, sum(times * spp)::double as spp, sum(times * syy)::double as syy, sum(times * spy)::double as spy from dr join m using (subject_id, ordinal) group by all)
select subject_id, target, resample, round((spy / n - sp / n * sy / n) / sqrt((spp / n - pow(sp / n, 2)) * (syy / n - pow(sy / n, 2))), 5) as r from w""")
def _(spark, d, resamples=RESAMPLES):
    rows = sensor(spark, d)
    p, y = F.col("p").cast("long"), F.col("y").cast("long")
    m = predicted(rows).where("seed = 0").groupBy("subject_id", "target", "night").agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(p * p).alias("spp"), F.sum(y * y).alias("syy"), F.sum(p * y).alias("spy"))
    sums = ["n", "sp", "sy", "spp", "syy", "spy"]
    w = stats.resampled_sums(m.join(numbered(rows), ["subject_id", "night"]), "target", sums, resamples).withColumns({c: F.col(c).cast("double") for c in sums})
    n = F.col("n")
    cov = F.col("spy") / n - F.col("sp") / n * F.col("sy") / n
    return w.select("subject_id", "target", "resample", F.round(F.try_divide(cov, F.sqrt((F.col("spp") / n - F.pow(F.col("sp") / n, 2)) * (F.col("syy") / n - F.pow(F.col("sy") / n, 2)))), 5).alias("r"))


@query("N06_eta_bootstrap", f"""with {_CTX}, o as (select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s), k as (select subject_id, max(ordinal) as n from o group by 1),
dr as (select subject_id, r as resample, (r * 7919 + j * 104729 + (r * j) % 8191 * 31) % n + 1 as ordinal, count(*) as times from k, (select unnest(generate_series(0, 49)) as r), lateral (select unnest(generate_series(0, n - 1)) as j) group by all),
g as (select subject_id, ordinal, coalesce(code, 'UNKNOWN') as st, count(*) as n, sum(temperature) as t, sum(temperature * temperature) as q from ctx join o using (subject_id, night) group by all),
b as (select subject_id, resample, st, sum(times * n)::double as n, sum(times * t)::double as t, sum(times * q)::double as q from dr join g using (subject_id, ordinal) group by all)
select subject_id, resample, round((sum(t * t / n) - sum(t) * sum(t) / sum(n)) / (sum(q) - sum(t) * sum(t) / sum(n)), 6) as eta2 from b group by 1, 2""")
def _(spark, d, resamples=50):
    t = F.col("temperature")
    g = heater(spark, d).groupBy("subject_id", "night", "state").agg(F.count("*").alias("n"), F.sum(t).alias("t"), F.sum(t * t).alias("q"))
    b = stats.resampled_sums(g.join(numbered(sensor(spark, d)), ["subject_id", "night"]), "state", ["n", "t", "q"], resamples).withColumns({c: F.col(c).cast("double") for c in ("n", "t", "q")})
    mid = F.sum("t") * F.sum("t") / F.sum("n")
    return b.groupBy("subject_id", "resample").agg(F.round(F.try_divide(F.sum(F.col("t") * F.col("t") / F.col("n")) - mid, F.sum("q") - mid), 6).alias("eta2"))


@query("O01_cases", f"with {PREDICTED}, m as (select subject_id, target, corr(p, y) as r from pred where seed = 0 group by all) select target, case when r is null then 'undefined' when r >= 0.3 then 'follows' when r <= -0.3 then 'opposes' else 'flat' end as verdict, count(*) as subjects, count(*) >= 2 as headline from m group by 1, 2")
def _(spark, d):
    m = predicted(placed(spark, d)).where("seed = 0").groupBy("subject_id", "target").agg(agg.pearson(F.col("p"), F.col("y")).alias("r"))
    verdict = F.when(F.col("r").isNull(), "undefined").when(F.col("r") >= 0.3, "follows").when(F.col("r") <= -0.3, "opposes").otherwise("flat")
    return m.groupBy("target", verdict.alias("verdict")).agg(F.count("*").alias("subjects"), (F.count("*") >= 2).alias("headline"))


@query("O02_interpretation", f"with {_BOOT}, q as (select subject_id, target, quantile_cont(mae_b - mae_a, 0.025) as lo, quantile_cont(mae_b - mae_a, 0.975) as hi from boot group by 1, 2) select target, count(*) filter (where lo > 0) as worse, count(*) filter (where hi < 0) as better, count(*) filter (where lo <= 0 and hi >= 0) as open from q group by 1")
def _(spark, d, resamples=RESAMPLES):
    x = F.col("mae_b") - F.col("mae_a")
    q = bootstrap(spark, d, resamples).groupBy("subject_id", "target").agg(F.percentile(x, 0.025).alias("lo"), F.percentile(x, 0.975).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return q.groupBy("target").agg(F.count_if(lo > 0).alias("worse"), F.count_if(hi < 0).alias("better"), F.count_if((lo <= 0) & (hi >= 0)).alias("open"))


# The queries above with the draws of the reference; their own SQL fixes them at 200 and 50.
WHOLE = 2_000
for _name in ("N01_draws", "N02_resampled_errors", "N04_paired_bootstrap", "N05_correlation_bootstrap", "O02_interpretation"):
    Q[f"{_name}_whole"] = lambda spark, d, f=Q[_name]: f(spark, d, WHOLE)
    SQL[f"{_name}_whole"] = SQL[_name].replace(f"generate_series(0, {RESAMPLES - 1})", f"generate_series(0, {WHOLE - 1})")


@query("N06_eta_interval", f"""with e as ({SQL["N06_eta_bootstrap"].replace("generate_series(0, 49)", f"generate_series(0, {WHOLE - 1})")})
select subject_id, count(*) as resamples, count(eta2) as defined, round(quantile_cont(eta2, 0.025), 6) as lo, round(quantile_cont(eta2, 0.975), 6) as hi from e group by 1""")
def _(spark, d):
    e = Q["N06_eta_bootstrap"](spark, d, WHOLE)
    return e.groupBy("subject_id").agg(F.count("*").alias("resamples"), F.count("eta2").alias("defined"), F.round(F.percentile("eta2", 0.025), 6).alias("lo"), F.round(F.percentile("eta2", 0.975), 6).alias("hi"))


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
