"""Queries of joins over time, aggregates and ordered scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.functions import quality, scalars
from brackwater.operators import joins, series
from brackwater.operators.ordered import islands, neighbour
from brackwater.plans.views import PLACED, SENSOR, P, placed, sensor
from brackwater.shared import table, written

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


def pair(spark, d):
    s = sensor(spark, d).where("subject_id = 'U02'")
    return s.where("device_id = 'd0'"), s.where("device_id = 'd1'")


PAIR = SENSOR + ", a as (select * from s where subject_id = 'U02' and device_id = 'd0'), b as (select * from s where subject_id = 'U02' and device_id = 'd1')"


def _near(tol: int, lag: str = "0") -> str:
    return f"(select a.*, x.row_id as b_row, x.ts_s as b_ts, x.temperature as b_temperature, row_number() over (partition by a.row_id order by abs(x.ts_s - a.ts_s - {lag}), x.ts_s, x.row_id) as rk from a join b x on x.ts_s between a.ts_s + {lag} - {tol} and a.ts_s + {lag} + {tol})"


@query("F01_nearest", f"with {PAIR} select row_id, b_ts, b_ts - ts_s as delta from {_near(3)} where rk = 1")
def _(spark, d):
    a, b = pair(spark, d)
    return joins.nearest(a, b, ["subject_id"], "ts_s", ["row_id"], 3).where("near is not null").select("row_id", F.col("near.t").alias("b_ts"), (F.col("near.t") - F.col("ts_s")).alias("delta"))


_EV = "ev as (select subject_id, device_id, ts_s, row_id, case when event_raw like 'AHON%' then 'ON' else 'OFF' end as code from s where regexp_matches(event_raw, 'AHON|AHOF'))"
_CTX = f"""{SENSOR}, {_EV}, ctx as (select s.*, arg_max(ev.code, (ev.ts_s, ev.row_id)) as code, max(ev.ts_s) as event_s
  from s left join ev on ev.subject_id = s.subject_id and ev.device_id = s.device_id and ev.ts_s <= s.ts_s and ev.ts_s >= s.ts_s - 60 group by all)"""


def events_of(s: DataFrame) -> DataFrame:
    return s.where(F.col("event_raw").rlike("AHON|AHOF")).select(*ST, "ts_s", "row_id", F.when(F.col("event_raw").startswith("AHON"), "ON").otherwise("OFF").alias("code"))


def heater(spark, d) -> DataFrame:
    s = sensor(spark, d)
    return joins.asof(s, events_of(s), ST, "ts_s", ["code"], 60, "row_id").withColumn("state", F.coalesce("event.code", F.lit("UNKNOWN")))


@query("F02_asof_event", f"with {_CTX} select row_id, coalesce(code, 'UNKNOWN') as state, ts_s - event_s as age_s from ctx")
def _(spark, d):
    return heater(spark, d).select("row_id", "state", (F.col("ts_s") - F.col("event.t")).alias("age_s"))


@query("F03_context_by_subject", f"with {_CTX} select subject_id, coalesce(code, 'UNKNOWN') as state, count(*) as n from ctx group by all")
def _(spark, d):
    return heater(spark, d).groupBy("subject_id", "state").agg(F.count("*").alias("n"))


@query("F04_alignment", f"with {PAIR}, n as (select a.row_id, min(abs(b_ts - ts_s)) filter (where rk = 1) as delta from a left join (select row_id, b_ts, rk from {_near(3)}) z using (row_id) group by a.row_id, ts_s), u as (select unnest([0, 1, 3]) as tol) select tol, round(avg((coalesce(delta, 99) <= tol)::int), 6) as matched_share from n, u group by tol".replace("min(abs(b_ts - ts_s))", "min(abs(z.b_ts - a.ts_s))").replace("where rk = 1) as delta", "where z.rk = 1) as delta"))
def _(spark, d):
    a, b = pair(spark, d)
    n = joins.nearest(a, b, ["subject_id"], "ts_s", ["row_id"], 3).select(F.abs(F.col("near.t") - F.col("ts_s")).alias("delta"))
    return n.select("delta", F.explode(F.array(*[F.lit(x) for x in (0, 1, 3)])).alias("tol")).groupBy("tol").agg(F.round(F.avg(F.coalesce((F.col("delta") <= F.col("tol")).cast("int"), F.lit(0))), 6).alias("matched_share"))


@query("F05_lagged_correlation", f"with {PAIR}, l as (select unnest([-4, 0, 4]) as lag), n as (select lag, a.row_id, a.temperature as x, x.temperature as y, row_number() over (partition by lag, a.row_id order by abs(x.ts_s - a.ts_s - lag), x.ts_s) as rk from l, a join b x on x.ts_s between a.ts_s + lag - 3 and a.ts_s + lag + 3) select lag, count(*) as n, round(corr(x, y), 6) as r from n where rk = 1 group by lag".replace("from l, a join b x", "from l cross join a join b x"))
def _(spark, d):
    a, b = pair(spark, d)
    shifted = a.select(F.explode(F.array(*[F.lit(x) for x in (-4, 0, 4)])).alias("lag"), "row_id", "ts_s", F.col("temperature").alias("x")).withColumn("ts_s", F.col("ts_s") + F.col("lag"))
    every = b.select(F.explode(F.array(*[F.lit(x) for x in (-4, 0, 4)])).alias("lag"), "ts_s", F.col("temperature").alias("y"), F.col("row_id").alias("b_row"))
    n = joins.nearest(shifted, every, ["lag"], "ts_s", ["y"], 3, "b_row").where("near is not null")
    return n.groupBy("lag").agg(F.count("*").alias("n"), F.round(series.pearson(F.col("x"), F.col("near.y")), 6).alias("r"))


@query("F06_coincidence", f"""with {PAIR}, ea as (select * from a where row_id % 12 < 2), eb as (select * from b where row_id % 12 < 2),
c as (select ea.row_id, k.shift, exists (select 1 from eb where eb.ts_s between ea.ts_s + k.shift - 10 and ea.ts_s + k.shift + 10) as hit from ea, (values (-86400), (0), (86400)) k(shift))
select round(avg(hit::int) filter (where shift = 0), 6) as observed, round(avg(hit::int) filter (where shift <> 0), 6) as control from c""")
def _(spark, d):
    a, b = (x.where("row_id % 12 < 2") for x in pair(spark, d))
    shifts = F.explode(F.array(*[F.lit(x) for x in (-86_400, 0, 86_400)]))
    copies = a.select("subject_id", "row_id", shifts.alias("shift"), "ts_s").withColumn("ts_s", F.col("ts_s") + F.col("shift"))
    hit = F.col("near").isNotNull().cast("int")
    n = joins.nearest(copies, b, ["subject_id"], "ts_s", ["row_id"], 10)
    return n.agg(F.round(F.avg(F.when(F.col("shift") == 0, hit)), 6).alias("observed"), F.round(F.avg(F.when(F.col("shift") != 0, hit)), 6).alias("control"))


@query("F07_event_lag_scan", f"""with {PAIR}, ea as (select * from a where row_id % 12 < 2), eb as (select * from b where row_id % 12 < 2), l as (select unnest(generate_series(-20, 20, 10)) as lag)
select lag, sum(exists(select 1 from eb where eb.ts_s between ea.ts_s + lag - 5 and ea.ts_s + lag + 5)::int) as hits, count(*) as n from ea, l group by lag""")
def _(spark, d):
    a, b = (x.where("row_id % 12 < 2") for x in pair(spark, d))
    copies = a.select("subject_id", F.explode(F.sequence(F.lit(-20).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"))).alias("lag"), "ts_s").withColumn("ts_s", F.col("ts_s") + F.col("lag"))
    return joins.nearest(copies, b, ["subject_id"], "ts_s", ["row_id"], 5).groupBy("lag").agg(F.count("near").alias("hits"), F.count("*").alias("n"))


@query("F08_trajectory", f"""with {SENSOR}, e as (select * from s where event_raw like 'AHON%'), o as (select unnest([-10, 10, 20]) as shift),
n as (select e.row_id, shift, e.temperature as t0, x.temperature as t1, row_number() over (partition by e.row_id, shift order by abs(x.ts_s - e.ts_s - shift), x.ts_s, x.row_id desc) as rk
  from e cross join o join s x on x.subject_id = e.subject_id and x.device_id = e.device_id and x.ts_s between e.ts_s + shift - 3 and e.ts_s + shift + 3 and x.row_id % 100 <> 1)
select shift, count(*) as n, sum(t1 - t0) as change from n where rk = 1 group by shift""")
def _(spark, d):
    s = sensor(spark, d)
    e = s.where(F.col("event_raw").startswith("AHON")).select(*ST, "row_id", F.explode(F.array(*[F.lit(x) for x in (-10, 10, 20)])).alias("shift"), F.col("temperature").alias("t0"), "ts_s").withColumn("ts_s", F.col("ts_s") + F.col("shift"))
    n = joins.nearest(e, s.where("row_id % 100 <> 1"), ST, "ts_s", ["temperature"], 3, "row_id").where("near is not null")
    return n.groupBy("shift").agg(F.count("*").alias("n"), F.sum(F.col("near.temperature") - F.col("t0")).alias("change"))


# Whole forms of F06-F08: the movement events, coverage and lift of the reference for every subject with two devices, and validity by the temperature.
_MOVED = SENSOR + """, one as (select subject_id, device_id, ts_s, min(row_id) as row_id, arg_min(p1, row_id) as p1, arg_min(p2, row_id) as p2, arg_min(p3, row_id) as p3, arg_min(p4, row_id) as p4, arg_min(p5, row_id) as p5, arg_min(p6, row_id) as p6 from s group by all),
ch as (select *, p1 + p2 + p3 + p4 + p5 + p6 as load, case when ts_s - lag(ts_s) over w <= 5 then abs(p1 - lag(p1) over w) + abs(p2 - lag(p2) over w) + abs(p3 - lag(p3) over w) + abs(p4 - lag(p4) over w) + abs(p5 - lag(p5) over w) + abs(p6 - lag(p6) over w) end as change
  from one window w as (partition by subject_id, device_id order by ts_s)),
th as (select subject_id, device_id, quantile_cont(change, 0.95) filter (where load > 0) as least from ch group by all),
ev as (select subject_id, device_id, ts_s from ch join th using (subject_id, device_id) where coalesce(change, 0) >= least),
cov as (select subject_id, device_id, ts_s as lo, ts_s + least(coalesce(lead(ts_s) over (partition by subject_id, device_id order by ts_s) - ts_s, 1), 60) as hi from one),
dev as (select distinct subject_id, device_id from one), pr as (select a.subject_id, a.device_id as device_a, b.device_id as device_b from dev a join dev b on a.subject_id = b.subject_id and a.device_id <> b.device_id)"""


def _hits(shifts: str, within: int) -> str:
    return f"""c as (select pr.*, k.shift, ev.ts_s + k.shift as t from pr join ev on ev.subject_id = pr.subject_id and ev.device_id = device_a cross join {shifts}),
i as (select c.* from c where exists (select 1 from cov where cov.subject_id = c.subject_id and cov.device_id = device_b and c.t >= lo and c.t < hi) and exists (select 1 from ev where ev.subject_id = c.subject_id and ev.device_id = device_b)),
h as (select i.*, exists (select 1 from ev where ev.subject_id = i.subject_id and ev.device_id = device_b and ev.ts_s between i.t - {within} and i.t + {within})::int as hit from i)"""


def moved(spark, d, shifts, within: int) -> tuple[DataFrame, DataFrame]:
    """Ordered device pairs of every subject, and the shifted movement events of a in the coverage of b with their hits."""
    one = sensor(spark, d).groupBy(*ST, "ts_s", "day").agg(F.min("row_id").alias("row_id"), F.min_by(F.struct(*P), "row_id").alias("_p")).select(*ST, "ts_s", "day", "row_id", "_p.*")
    one = written(one, "moments")
    ev = written(series.movements(one, ST, ORD, "day", "ts_s", P, 0.95).select(*ST, "ts_s"), "movements")
    other = lambda x: x.withColumnRenamed("device_id", "device_b")
    dev = one.select(*ST).distinct()
    pairs = dev.withColumnRenamed("device_id", "device_a").join(other(dev), "subject_id").where("device_a <> device_b")
    heard = pairs.join(other(ev).select("subject_id", "device_b").distinct(), ["subject_id", "device_b"], "left_semi")
    copies = heard.join(ev.withColumnRenamed("device_id", "device_a"), ["subject_id", "device_a"]).withColumn("shift", F.explode(shifts)).withColumn("ts_s", F.col("ts_s") + F.col("shift"))
    coverage = other(joins.covered(one, ST, ORD, "ts_s", "day", 60, last_s=1))
    return pairs, joins.coincidence(copies, other(ev), coverage, ["subject_id", "device_b"], "ts_s", within)


@query("F06_event_coincidence", f"""with {_MOVED}, {_hits("(values (-86400), (0), (86400)) k(shift)", 10)},
g as (select subject_id, device_a, device_b, count(*) filter (where shift = 0) as n_events, avg(hit) filter (where shift = 0) as o, count(*) filter (where shift <> 0) as n_control, avg(hit) filter (where shift <> 0) as k from h group by all)
select subject_id, device_a, device_b, coalesce(n_events, 0) as n_events, round(o, 6) as observed, coalesce(n_control, 0) as n_control, round(k, 6) as control, round(o / nullif(k, 0), 6) as lift from pr left join g using (subject_id, device_a, device_b)""")
def _(spark, d):
    pairs, h = moved(spark, d, F.array(*[F.lit(x) for x in (-86_400, 0, 86_400)]), 10)
    now = F.col("shift") == 0
    g = h.groupBy("subject_id", "device_a", "device_b").agg(F.count_if(now).alias("n_events"), F.avg(F.when(now, F.col("hit"))).alias("_o"), F.count_if(~now).alias("n_control"), F.avg(F.when(~now, F.col("hit"))).alias("_k"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pairs.join(g, ["subject_id", "device_a", "device_b"], "left").select("subject_id", "device_a", "device_b", n("n_events"), F.round("_o", 6).alias("observed"), n("n_control"), F.round("_k", 6).alias("control"), F.round(F.try_divide("_o", "_k"), 6).alias("lift"))


@query("F07_covered_lag_scan", f"""with {_MOVED}, {_hits("(select unnest(generate_series(-20, 20, 10)) as shift) k", 5)},
g as (select subject_id, device_a, device_b, shift as lag, count(*) as n_events, round(avg(hit), 6) as share from h group by all)
select subject_id, device_a, device_b, lag, coalesce(n_events, 0) as n_events, share from (select pr.*, l.lag from pr, (select unnest(generate_series(-20, 20, 10)) as lag) l) left join g using (subject_id, device_a, device_b, lag)""")
def _(spark, d):
    lags = F.sequence(F.lit(-20).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"))
    pairs, h = moved(spark, d, lags, 5)
    keys = ["subject_id", "device_a", "device_b", "lag"]
    g = h.withColumnRenamed("shift", "lag").groupBy(*keys).agg(F.count("*").alias("n_events"), F.round(F.avg("hit"), 6).alias("share"))
    return pairs.withColumn("lag", F.explode(lags)).join(g, keys, "left").select(*keys, F.coalesce("n_events", F.lit(0)).alias("n_events"), "share")


@query("F08_valid_trajectory", f"""with {SENSOR}, e as (select * from s where event_raw like 'AHON%' and temperature between 1 and 59), o as (select unnest([-10, 10, 20]) as shift),
c as (select e.row_id, shift, e.ts_s + shift as t, any_value(e.temperature) as t0, arg_max({{'t': x.ts_s, 'y': x.temperature}}, (x.ts_s, x.row_id)) filter (where x.ts_s < e.ts_s + shift) as b, arg_min({{'t': x.ts_s, 'y': x.temperature}}, (x.ts_s, x.row_id)) filter (where x.ts_s >= e.ts_s + shift) as a
  from e cross join o left join s x on x.subject_id = e.subject_id and x.device_id = e.device_id and x.ts_s between e.ts_s + shift - 3 and e.ts_s + shift + 3 group by e.row_id, shift, e.ts_s),
v as (select *, case when b.y between 1 and 59 then t - b.t end as db, case when a.y between 1 and 59 then a.t - t end as da from c)
select shift, count(*) as n_events, count(coalesce(db, da)) as n, sum(case when da is null or db <= da then b.y else a.y end - t0) filter (where coalesce(db, da) is not null)::bigint as change from v group by shift""")
def _(spark, d):
    s = sensor(spark, d)
    good = lambda c: c.between(1, 59)
    e = s.where(F.col("event_raw").startswith("AHON") & good(F.col("temperature")))
    e = e.select(*ST, "row_id", F.explode(F.array(*[F.lit(x) for x in (-10, 10, 20)])).alias("shift"), F.col("temperature").alias("t0"), "ts_s").withColumn("ts_s", F.col("ts_s") + F.col("shift"))
    n = joins.adjacent(e, s, ST, "ts_s", ["temperature"], "row_id")
    away = lambda c: F.when(good(F.col(f"{c}.temperature")) & (F.abs(F.col(f"{c}.t") - F.col("ts_s")) <= 3), F.abs(F.col(f"{c}.t") - F.col("ts_s")))
    n = n.withColumns({"_b": away("before"), "_a": away("after")})
    y = F.when(F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_b") <= F.col("_a"))), F.col("before.temperature")).when(F.col("_a").isNotNull(), F.col("after.temperature"))
    return n.groupBy("shift").agg(F.count("*").alias("n_events"), F.count(y).alias("n"), F.sum(y - F.col("t0")).alias("change"))


@query("F09_neighbour_valid", f"""with {SENSOR}, v as (select *, case when temperature between 1 and 59 then temperature end as good, case when temperature between 1 and 59 then ts_s end as good_s from s)
select row_id, before_value, before_age, after_value, after_age from (select row_id, temperature, last_value(good ignore nulls) over p as before_value, ts_s - last_value(good_s ignore nulls) over p as before_age, first_value(good ignore nulls) over f as after_value, first_value(good_s ignore nulls) over f - ts_s as after_age
  from v window p as (partition by subject_id, device_id order by ts_s, row_id rows between unbounded preceding and 1 preceding), f as (partition by subject_id, device_id order by ts_s, row_id rows between 1 following and unbounded following))
where temperature not between 1 and 59""")
def _(spark, d):
    from brackwater.shared import sharded_previous

    v = sensor(spark, d).withColumn("_good", F.when(F.col("temperature").between(1, 59), F.struct("temperature", "ts_s")))
    v = sharded_previous(sharded_previous(v, ST, ORD, "day", "_good", "_p"), ST, ORD, "day", "_good", "_n", ahead=True).where("_good is null")
    return v.select("row_id", F.col("_p.temperature").alias("before_value"), (F.col("ts_s") - F.col("_p.ts_s")).alias("before_age"), F.col("_n.temperature").alias("after_value"), (F.col("_n.ts_s") - F.col("ts_s")).alias("after_age"))


@query("F10_minute_reconcile", f"""with {SENSOR}, c as (select subject_id, device_id, ts_s // 60 as minute, list(temperature order by ts_s, row_id) as v from s where row_id % 50 <> 3 group by all),
t as (select subject_id, device_id, ts_s // 60 as minute, list(case when row_id % 71 = 0 then 99 else temperature end order by ts_s, row_id) as v from s where row_id % 60 <> 5 group by all)
select coalesce(c.subject_id, t.subject_id) as subject_id, case when t.v is null then 'csv_only' when c.v is null then 'txt_only' when len(c.v) <> len(t.v) then 'count_mismatch' when c.v <> t.v then 'value_mismatch' else 'included' end as category, count(*) as n
from c full join t using (subject_id, device_id, minute) group by all""")
def _(spark, d):
    s = sensor(spark, d).withColumn("minute", F.expr("ts_s div 60"))
    t = s.where("row_id % 60 <> 5").withColumn("temperature", F.expr("case when row_id % 71 = 0 then 99 else temperature end"))
    return series.reconcile(s.where("row_id % 50 <> 3"), t, [*ST, "minute"], ORD, ["temperature"]).groupBy("subject_id", "category").agg(F.count("*").alias("n"))


@query("F11_split_assignment", f"with {PLACED}, k as (select subject_id, session, case when session % 5 = 0 then 'test' else 'train' end as part from placed group by all) select part, count(*) as n from placed join k using (subject_id, session) group by part")
def _(spark, d):
    rows = placed(spark, d)
    split = rows.select("subject_id", "session").distinct().withColumn("part", F.when(F.col("session") % 5 == 0, "test").otherwise("train"))
    return rows.join(split, ["subject_id", "session"]).groupBy("part").agg(F.count("*").alias("n"))


@query("F12_key_alignment", "with a as (select distinct device_id, t0 from windows where t0 is not null and labelled), b as (select distinct device_id, t0 from windows where t0 is not null and window_id % 9 <> 0) select count(a.t0) as n_a, count(b.t0) as n_b, count(*) filter (where a.t0 is not null and b.t0 is not null) as n_both from a full join b on a.device_id = b.device_id and a.t0 = b.t0")
def _(spark, d):
    w = table(spark, d, "windows").where("t0 is not null")
    a, b = (x.select("device_id", "t0").distinct() for x in (w.where("labelled"), w.where("window_id % 9 <> 0")))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["device_id", "t0"], "full_outer")
    return both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))


@query("F14_common_endpoints", "select subject_id, count(*) as n from windows w where labelled and t0 is not null and exists (select 1 from windows x where x.subject_id = w.subject_id and x.device_id = w.device_id and x.t0 = w.t0 - 20) group by 1")
def _(spark, d):
    w = table(spark, d, "windows").where("t0 is not null")
    earlier = w.select("subject_id", "device_id", (F.col("t0") + 20).alias("t0")).distinct()
    return w.where("labelled").join(earlier, ["subject_id", "device_id", "t0"], "left_semi").groupBy("subject_id").agg(F.count("*").alias("n"))


_COV = "select {k}, ts_s as lo, ts_s + least(coalesce(lead(ts_s) over (partition by {k} order by ts_s, row_id) - ts_s, 5), 5) as hi from {t}"


@query("F15_coverage_overlap", f"with {PAIR}, ia as ({_COV.format(k='subject_id', t='a')}), ib as ({_COV.format(k='subject_id', t='b')}) select sum(least(ia.hi, ib.hi) - greatest(ia.lo, ib.lo))::bigint as seconds_both, (select sum(hi - lo) from ia)::bigint as seconds_a, (select sum(hi - lo) from ib)::bigint as seconds_b from ia join ib on ia.lo < ib.hi and ib.lo < ia.hi")
def _(spark, d):
    a, b = (joins.covered(x, ["subject_id"], ORD, "ts_s", "day", 5) for x in pair(spark, d))
    own = lambda x: x.agg(F.sum(F.col("hi") - F.col("lo"))).scalar()
    both = joins.overlap(a, b, ["subject_id"]).agg(F.sum("seconds").alias("seconds_both"))
    return both.withColumn("seconds_a", own(a)).withColumn("seconds_b", own(b))


@query("F16_merged_hours", f"with {SENSOR}, r as (select subject_id, file_no, min(ts_s) as lo, max(ts_s) + 600 as hi from s group by all), m as (select subject_id, lo, hi, max(hi) over (partition by subject_id order by lo, hi rows between unbounded preceding and 1 preceding) as seen from r) select subject_id, sum(greatest(hi - greatest(lo, coalesce(seen, lo)), 0))::bigint as seconds from m group by 1")
def _(spark, d):
    r = sensor(spark, d).groupBy("subject_id", "file_no").agg(F.min("ts_s").alias("lo"), (F.max("ts_s") + 600).alias("hi"))
    return joins.merged_length(r, ["subject_id"], "lo", "hi")


@query("F17_file_chain", f"with {SENSOR}, r as (select subject_id, file_no, min(ts_s) as lo, max(ts_s) as hi from s group by all) select subject_id, file_no, lead(lo) over (partition by subject_id order by lo, file_no) - hi as gap_s from r")
def _(spark, d):
    r = sensor(spark, d).groupBy("subject_id", "file_no").agg(F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi")).withColumn("day", F.expr("lo div 86400"))
    return neighbour(r, ["subject_id"], ["lo", "file_no"], "day", ["lo"], "_n", ahead=True).select("subject_id", "file_no", (F.col("_n.lo") - F.col("hi")).alias("gap_s"))


@query("F18_excluded_sources", "select source_id, count(*) as n from sensor_rows where source_id not in (select source_id from log_files where source_id is not null and headers is null) group by 1")
def _(spark, d):
    out = table(spark, d, "log_files").where("headers is null").select("source_id").distinct()
    return table(spark, d, "sensor_rows").join(out, "source_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


@query("G01_group_spans", f"with {PLACED} select subject_id, device_id, session, min(ts_s) as first_s, max(ts_s) as last_s, count(*) as n from placed group by all")
def _(spark, d):
    return placed(spark, d).groupBy(*ST, "session").agg(F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.count("*").alias("n"))


@query("G02_slice_table", f"with {PLACED} select subject_id, count(*) as n, count(distinct device_id || session::varchar) as sessions, count(*) filter (where temperature between 1 and 59) as valid, min(ts_s) as first_s, max(ts_s) as last_s from placed group by 1")
def _(spark, d):
    return placed(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"), F.count_distinct(F.concat("device_id", F.col("session").cast("string"))).alias("sessions"), F.count_if(F.col("temperature").between(1, 59)).alias("valid"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


@query("G03_reconciliation", "select source_id, count(*) as raw_rows, count(*) filter (where ts is null) as undated, count(*) filter (where ts is not null) - count(distinct case when ts is not null then (device_id, ts, p1, p2, p3, p4, p5, p6, temp, humid) end) as copies, count(distinct case when ts is not null then (device_id, ts, p1, p2, p3, p4, p5, p6, temp, humid) end) as kept from sensor_rows group by 1")
def _(spark, d):
    one = table(spark, d, "sensor_rows").groupBy("source_id", "device_id", "ts", *P, "temp", "humid").agg(F.count("*").alias("n"))
    dated = F.col("ts").isNotNull()
    g = one.groupBy("source_id").agg(F.sum("n").alias("raw_rows"), F.coalesce(F.sum(F.when(~dated, F.col("n"))), F.lit(0)).alias("undated"), F.count_if(dated).alias("kept"))
    return g.select("source_id", "raw_rows", "undated", (F.col("raw_rows") - F.col("undated") - F.col("kept")).alias("copies"), "kept")


@query("G04_summary", f"with {SENSOR} select subject_id, count(*) as n, round(avg(p1), 6) as mean, round(stddev_pop(p1), 6) as sd, quantile_cont(p1, 0.5) as median, quantile_cont(p1, 0.25) as q25, quantile_cont(p1, 0.75) as q75, min(p1) as low, max(p1) as high, round(avg((p1 = 0)::int), 6) as zero_share from s group by 1")
def _(spark, d):
    return sensor(spark, d).groupBy("subject_id").agg(*series.summary(F.col("p1")))


@query("G05_unit_statistic", f"with {SENSOR}, u as (select subject_id, night, quantile_cont(temperature, 0.5) as m from s group by all) select subject_id, quantile_cont(m, 0.5) as median_of_medians, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) as iqr_of_medians from u group by 1")
def _(spark, d):
    u = sensor(spark, d).groupBy("subject_id", "night").agg(F.percentile("temperature", 0.5).alias("m"))
    return u.groupBy("subject_id").agg(F.percentile("m", 0.5).alias("median_of_medians"), (F.percentile("m", 0.75) - F.percentile("m", 0.25)).alias("iqr_of_medians"))


@query("G06_top_values", f"with {SENSOR}, c as (select subject_id, temperature, count(*) as n from s group by all), r as (select *, row_number() over (partition by subject_id order by n desc, temperature) as rk, sum(n) over (partition by subject_id) as total from c) select subject_id, temperature, n, rk, round(n / total, 6) as share from r where rk <= 5")
def _(spark, d):
    return series.top_values(sensor(spark, d), ["subject_id"], "temperature", 5)


@query("G07_active_hours", f"with {SENSOR}, m as (select subject_id, ts_s // 60 as minute, bool_or(temperature between 1 and 59) as ok from s group by all), h as (select subject_id, minute // 1440 as day, count(*) filter (where ok) as ok_minutes, count(*) as minutes from m group by all) select subject_id, round(sum(minutes) / 60.0, 6) as hours, count(*) filter (where ok_minutes >= 3) as usable_days from h group by 1")
def _(spark, d):
    m = sensor(spark, d).groupBy("subject_id", F.expr("ts_s div 60").alias("minute")).agg(F.bool_or(F.col("temperature").between(1, 59)).alias("ok"))
    h = m.groupBy("subject_id", F.expr("minute div 1440").alias("day")).agg(F.count_if("ok").alias("ok_minutes"), F.count("*").alias("minutes"))
    return h.groupBy("subject_id").agg(F.round(F.sum("minutes") / 60.0, 6).alias("hours"), F.count_if(F.col("ok_minutes") >= 3).alias("usable_days"))


_STEP = f"{SENSOR}, st as (select *, ts_s - lag(ts_s) over (partition by subject_id, device_id order by ts_s, row_id) as step from s)"


def steps(spark, d) -> DataFrame:
    return neighbour(sensor(spark, d), ST, ORD, "day", ["ts_s"], "_b").withColumn("step", F.col("ts_s") - F.col("_b.ts_s")).drop("_b")


@query("G08_dominant_step", f"with {_STEP}, c as (select subject_id, device_id, step, count(*) as n from st where step between 1 and 60 group by all) select subject_id, device_id, arg_min(step, (-n, step)) as dominant_step, max(n) as n from c group by 1, 2")
def _(spark, d):
    c = steps(spark, d).where("step between 1 and 60").groupBy(*ST, "step").agg(F.count("*").alias("n"))
    return c.groupBy(*ST).agg(F.min_by("step", F.struct(-F.col("n"), "step")).alias("dominant_step"), F.max("n").alias("n"))


@query("G09_daily_label", f"with {SENSOR}, c as (select day, event_raw, count(*) as n from s group by all) select day, arg_min(event_raw, (-n, event_raw)) as label from c group by day")
def _(spark, d):
    c = sensor(spark, d).groupBy("day", "event_raw").agg(F.count("*").alias("n"))
    return c.groupBy("day").agg(F.min_by("event_raw", F.struct(-F.col("n"), "event_raw")).alias("label"))


@query("G10_step_histogram", f"with {_STEP}, b as (select * from (values ('0', 0, 0), ('1-2', 1, 2), ('3-5', 3, 5), ('6-60', 6, 60), ('61-1800', 61, 1800), ('over', 1801, 999999999)) v(bucket, lo, hi)) select bucket, count(step) as n, coalesce(sum(step), 0)::bigint as seconds from b left join st on step between lo and hi group by bucket")
def _(spark, d):
    names = ("0", "1-2", "3-5", "6-60", "61-1800", "over")
    x = F.col("step")
    bucket = F.when(x == 0, "0").when(x <= 2, "1-2").when(x <= 5, "3-5").when(x <= 60, "6-60").when(x <= 1_800, "61-1800").otherwise("over")
    got = steps(spark, d).where("step >= 0").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("step").alias("seconds"))
    every = spark.createDataFrame([(x,) for x in names], "bucket string")
    return every.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seconds", F.lit(0)).alias("seconds"))


_LONG = "select subject_id, device_id, night, session, segment, ts_s, row_id, temperature, humidity, unnest([1, 2, 3, 4, 5, 6]) as channel, unnest([p1, p2, p3, p4, p5, p6]) as p from placed"


@query("G11_channel_stats", f"with {PLACED}, l as ({_LONG}) select subject_id, channel, count(*) filter (where p > 0) as active, count(*) filter (where p = 4095) as at_bound, quantile_cont(p, 0.5) filter (where p > 0) as median_loaded, round(sum(p) / nullif(sum(sum(p)) over (partition by subject_id), 0), 6) as mass_share from l group by all".replace("group by all", "group by subject_id, channel"))
def _(spark, d):
    x = series.channels(sensor(spark, d), P).groupBy("subject_id", "channel").agg(F.count_if(F.col("p") > 0).alias("active"), F.count_if(F.col("p") == 4_095).alias("at_bound"), F.percentile(F.when(F.col("p") > 0, F.col("p")), 0.5).alias("median_loaded"), F.sum("p").alias("_m"))
    return x.withColumn("mass_share", F.round(F.try_divide(F.col("_m"), F.sum("_m").over(Window.partitionBy("subject_id"))), 6)).drop("_m")


@query("G12_upper_bound", "select n_at_bound, count(*) as n from (select (p1 = 4095)::int + (p2 = 4095)::int + (p3 = 4095)::int + (p4 = 4095)::int + (p5 = 4095)::int + (p6 = 4095)::int as n_at_bound from sensor_rows where p1 + p2 + p3 + p4 + p5 + p6 is not null) group by 1")
def _(spark, d):
    p = [F.col(c) for c in P]
    rows = table(spark, d, "sensor_rows").where(quality.total([x.cast("long") for x in p]).isNotNull())
    return rows.groupBy(quality.at_bound(p).alias("n_at_bound")).agg(F.count("*").alias("n"))


_CONST = f"{PLACED}, fl as (select *, case when temperature is distinct from lag(temperature) over w or ts_s - lag(ts_s) over w > 60 then 1 else 0 end as fresh from (select * replace (temperature // 16 as temperature) from placed) window w as (partition by subject_id, device_id order by ts_s, row_id)), isl as (select *, sum(fresh) over (partition by subject_id, device_id order by ts_s, row_id rows unbounded preceding) as run from fl), runs as (select subject_id, device_id, run, min(temperature) as value, min(ts_s) as first_s, max(ts_s) - min(ts_s) as seconds, count(*) as n from isl group by all)"


def constant_runs(spark, d) -> DataFrame:
    banded = sensor(spark, d).withColumn("temperature", F.expr("temperature div 16"))
    runs = islands(banded, ST, ORD, "day", ["temperature", "ts_s"], lambda p: (p("temperature") != F.col("temperature")) | (F.col("ts_s") - p("ts_s") > 60), "run")
    return runs.groupBy(*ST, "run").agg(F.min("temperature").alias("value"), F.min("ts_s").alias("first_s"), (F.max("ts_s") - F.min("ts_s")).alias("seconds"), F.count("*").alias("n"))


@query("G13_run_table", f"with {_CONST} select least_s, count(*) filter (where seconds >= least_s) as n_runs, coalesce(sum(seconds) filter (where seconds >= least_s), 0)::bigint as seconds from runs, (values (0), (2), (4)) v(least_s) group by 1")
def _(spark, d):
    r = constant_runs(spark, d).select(F.explode(F.array(*[F.lit(x) for x in (0, 2, 4)])).alias("least_s"), "seconds")
    hit = F.col("seconds") >= F.col("least_s")
    return r.groupBy("least_s").agg(F.count_if(hit).alias("n_runs"), F.coalesce(F.sum(F.when(hit, F.col("seconds"))), F.lit(0)).alias("seconds"))


@query("G14_binned_sd", f"with {SENSOR} select subject_id, device_id, ts_s // 60 as bin, count(*) as n, round(stddev_pop(temperature), 6) as sd from s group by all having count(*) >= 10")
def _(spark, d):
    return sensor(spark, d).groupBy(*ST, F.expr("ts_s div 60").alias("bin")).agg(F.count("*").alias("n"), F.round(F.stddev_pop("temperature"), 6).alias("sd")).where("n >= 10")


@query("G15_binned_trend", "with q as (select list_distinct(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0])) as e from lineitem), e as (select row_number() over (order by x) as no, x as lo, lead(x) over (order by x) as hi from (select unnest(e) as x from q)) select no as bin, count(*) as n, quantile_cont(l_quantity, 0.5) as median_y from lineitem, e where hi is not null and l_extendedprice >= lo and (l_extendedprice < hi or (l_extendedprice = hi and no = (select max(no) - 1 from e))) group by no")
def _(spark, d):
    return series.binned_trend(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 4)


@query("G16_vocabulary", "select word, count(*) as n from (select unnest(regexp_split_to_array(trim(event_raw), '\\s+')) as word from sensor_rows where event_raw is not null) where word <> '' group by word")
def _(spark, d):
    words = table(spark, d, "sensor_rows").where("event_raw is not null").groupBy("event_raw").agg(F.count("*").alias("k"))
    return words.select(F.explode(F.split(F.trim("event_raw"), r"\s+")).alias("word"), "k").where("word <> ''").groupBy("word").agg(F.sum("k").alias("n"))


@query("G17_code_audit", f"with {SENSOR} select subject_id, device_id, count(*) filter (where event_raw <> 'LM') as events, count(distinct case when event_raw <> 'LM' then night end) as nights_with, count(distinct night) as nights from s group by 1, 2")
def _(spark, d):
    hit = F.col("event_raw") != "LM"
    return sensor(spark, d).groupBy(*ST).agg(F.count_if(hit).alias("events"), F.count_distinct(F.when(hit, F.col("night"))).alias("nights_with"), F.count_distinct("night").alias("nights"))


@query("G18_state_summary", f"with {_CTX} select state, count(c.row_id) as n, count(distinct c.night) as nights, round(avg(c.temperature), 6) as mean, quantile_cont(c.temperature, 0.5) as median, round(stddev_pop(c.temperature), 6) as sd from (values ('ON'), ('OFF'), ('UNKNOWN'), ('NEVER')) v(state) left join ctx c on coalesce(c.code, 'UNKNOWN') = v.state group by state")
def _(spark, d):
    states = spark.createDataFrame([("ON",), ("OFF",), ("UNKNOWN",), ("NEVER",)], "state string")
    g = heater(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("night").alias("nights"), F.round(F.avg("temperature"), 6).alias("mean"), F.percentile("temperature", 0.5).alias("median"), F.round(F.stddev_pop("temperature"), 6).alias("sd"))
    return states.join(g, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nights", F.lit(0)).alias("nights"), "mean", "median", "sd")


@query("G19_slice_summary", f"with {PLACED} select subject_id as slice, count(*) as n, count(distinct device_id || session::varchar) as sessions, count(distinct night) as nights, round(avg((p1 + p2 + p3 + p4 + p5 + p6 > 0)::int), 6) as loaded_share from placed group by 1")
def _(spark, d):
    return placed(spark, d).groupBy(F.col("subject_id").alias("slice")).agg(F.count("*").alias("n"), F.count_distinct(F.concat("device_id", F.col("session").cast("string"))).alias("sessions"), F.count_distinct("night").alias("nights"), F.round(F.avg((quality.total([F.col(c) for c in P]) > 0).cast("int")), 6).alias("loaded_share"))


@query("G20_distribution", f"with {SENSOR}, u as (select subject_id, night, unnest(['temperature', 'humidity']) as variable, unnest([temperature, humidity]) as x from s), n as (select subject_id, variable, night, quantile_cont(x, 0.5) as m from u group by all) select u.subject_id, u.variable, count(*) as n, quantile_cont(x, 0.5) as median, any_value(nm) as night_median from u join (select subject_id, variable, quantile_cont(m, 0.5) as nm from n group by all) z using (subject_id, variable) group by 1, 2")
def _(spark, d):
    u = sensor(spark, d).select("subject_id", "night", "temperature", "humidity").unpivot(["subject_id", "night"], ["temperature", "humidity"], "variable", "x")
    nights = u.groupBy("subject_id", "variable", "night").agg(F.percentile("x", 0.5).alias("m")).groupBy("subject_id", "variable").agg(F.percentile("m", 0.5).alias("night_median"))
    return u.groupBy("subject_id", "variable").agg(F.count("*").alias("n"), F.percentile("x", 0.5).alias("median")).join(nights, ["subject_id", "variable"])


@query("G21_by_period", f"with {SENSOR}, m as (select subject_id, night, quantile_cont(temperature, 0.5) as nm from s group by all) select s.subject_id, (ts_s % 86400) // 3600 as hour, count(*) as n, round(avg(temperature - nm), 6) as deviation from s join m using (subject_id, night) group by 1, 2")
def _(spark, d):
    s = sensor(spark, d)
    m = s.groupBy("subject_id", "night").agg(F.percentile("temperature", 0.5).alias("nm"))
    return s.join(m, ["subject_id", "night"]).groupBy("subject_id", scalars.div(F.col("ts_s") % 86_400, 3_600).alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("temperature") - F.col("nm")), 6).alias("deviation"))


@query("G22_since_start", f"with {PLACED} select row_id, round((ts_s - min(ts_s) over (partition by subject_id, device_id, session)) / 3600.0, 6) as hours from placed")
def _(spark, d):
    rows = placed(spark, d)
    first = rows.groupBy(*ST, "session").agg(F.min("ts_s").alias("_a"))
    return rows.join(first, [*ST, "session"]).select("row_id", F.round((F.col("ts_s") - F.col("_a")) / 3_600.0, 6).alias("hours"))


@query("G23_grouping_sets", f"with {SENSOR} select subject_id, device_id, event_raw, count(*) as n from s group by grouping sets ((subject_id, device_id), (subject_id, event_raw), ())")
def _(spark, d):
    return sensor(spark, d).groupingSets([["subject_id", "device_id"], ["subject_id", "event_raw"], []], "subject_id", "device_id", "event_raw").agg(F.count("*").alias("n"))


@query("G24_file_audit", "select file_id, count(*) as n_lines, count(*) filter (where line is null or trim(line) = '') as blank, count(*) filter (where contains(line, '\"')) as quoted, coalesce(max(length(line)), 0) as longest, min(line_no) as first_line, max(line_no) as last_line from raw_lines group by 1")
def _(spark, d):
    line = F.col("line")
    return table(spark, d, "raw_lines").groupBy("file_id").agg(F.count("*").alias("n_lines"), F.count_if(line.isNull() | (F.trim(line) == "")).alias("blank"), F.count_if(F.contains(line, F.lit('"'))).alias("quoted"), F.coalesce(F.max(F.length(line)), F.lit(0)).alias("longest"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("H01_bridged_sessions", f"with {SENSOR}, l as (select *, ts_s - lag(ts_s) over w as gap, file_no <> lag(file_no) over w as other_file from s window w as (partition by subject_id, device_id order by ts_s, row_id)), b as (select *, gap is null or (gap > 1800 and not (other_file and device_id = 'unknown' and gap >= 1500 and abs(gap - (gap + 900) // 1800 * 1800) <= 10 and (gap + 900) // 1800 between 1 and 3)) as fresh from l) select row_id, sum(fresh::int) over (partition by subject_id, device_id order by ts_s, row_id rows unbounded preceding) as session, gap as gap_before_s, coalesce(gap > 1800 and not fresh, false) as bridged from b")
def _(spark, d):
    return series.bridged_sessions(sensor(spark, d), ST, ORD, "day", "ts_s", "file_no", F.col("device_id") == "unknown").select("row_id", "session", "gap_before_s", "bridged")


@query("H02_thresholds", f"with {_STEP} select threshold, subject_id, device_id, count(*) filter (where step is null or step > threshold) as sessions from st, (values (5), (60), (1800), (7200)) v(threshold) group by all")
def _(spark, d):
    t = F.col("threshold")
    rows = steps(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (5, 60, 1_800, 7_200)])))
    return rows.groupBy("threshold", *ST).agg(F.count_if(F.col("step").isNull() | (F.col("step") > t)).alias("sessions"))


@query("H03_chunk_alignment", f"with {_STEP} select row_id, (step + 900) // 1800 as n_chunks, step - (step + 900) // 1800 * 1800 as residual, step >= 1500 and abs(step - (step + 900) // 1800 * 1800) <= 10 as aligned from st where step > 5")
def _(spark, d):
    n = F.expr("(step + 900) div 1800")
    rest = F.col("step") - n * 1_800
    return steps(spark, d).where("step > 5").select("row_id", n.alias("n_chunks"), rest.alias("residual"), ((F.col("step") >= 1_500) & (F.abs(rest) <= 10)).alias("aligned"))


@query("H04_session_stats", f"with {PLACED}, n as (select subject_id, device_id, session, count(*) as k, max(ts_s) - min(ts_s) as dur, count(distinct file_no) as files from placed group by all) select subject_id, count(*) as sessions, quantile_cont(dur, 0.5) as median_s, max(dur) as longest_s, count(*) filter (where files > 1) as over_files from n group by 1")
def _(spark, d):
    n = placed(spark, d).groupBy(*ST, "session").agg((F.max("ts_s") - F.min("ts_s")).alias("dur"), F.count_distinct("file_no").alias("files"))
    return n.groupBy("subject_id").agg(F.count("*").alias("sessions"), F.percentile("dur", 0.5).alias("median_s"), F.max("dur").alias("longest_s"), F.count_if(F.col("files") > 1).alias("over_files"))


@query("H05_gap_context", f"with {PLACED}, r as (select *, row_number() over (partition by subject_id, device_id, segment order by ts_s, row_id) as i, row_number() over (partition by subject_id, device_id, segment order by ts_s desc, row_id desc) as j from placed), x as (select subject_id, device_id, segment, round(avg(temperature) filter (where j <= 5), 6) as before_mean from r group by all), y as (select subject_id, device_id, segment - 1 as segment, round(avg(temperature) filter (where i <= 5), 6) as after_mean from r group by all) select * from x join y using (subject_id, device_id, segment)")
def _(spark, d):
    rows = placed(spark, d)
    w = Window.partitionBy(*ST, "segment")
    ends = rows.select(*ST, "segment", "temperature", F.row_number().over(w.orderBy(*ORD)).alias("i"), F.row_number().over(w.orderBy(F.desc("ts_s"), F.desc("row_id"))).alias("j"))
    side = lambda c, n: F.round(F.avg(F.when(F.col(c) <= 5, F.col("temperature"))), 6).alias(n)
    both = ends.groupBy(*ST, "segment").agg(side("j", "before_mean"), side("i", "after_mean"))
    return both.select(*ST, "segment", "before_mean").join(both.select(*ST, (F.col("segment") - 1).alias("segment"), "after_mean"), [*ST, "segment"])


@query("H06_same_time", f"with {SENSOR} select row_id, count(*) over (partition by subject_id, device_id, ts_s) as group_size, row_number() over (partition by subject_id, device_id, ts_s order by row_id) - 1 as place, min(row_id) over (partition by subject_id, device_id, ts_s) as group_id from s")
def _(spark, d):
    w = Window.partitionBy(*ST, "ts_s")
    return sensor(spark, d).select("row_id", F.count("*").over(w).alias("group_size"), (F.row_number().over(w.orderBy("row_id")) - 1).alias("place"), F.min("row_id").over(w).alias("group_id"))


@query("H07_constant_frame", f"with {SENSOR}, f as (select *, (p4, p5) is distinct from lag((p4, p5)) over w or ts_s - lag(ts_s) over w > 60 as fresh from s window w as (partition by subject_id, device_id order by ts_s, row_id)), i as (select *, sum(fresh::int) over (partition by subject_id, device_id order by ts_s, row_id rows unbounded preceding) as run from f) select row_id, case when p4 + p5 > 0 then max(ts_s) over w - min(ts_s) over w else 0 end as seconds from i window w as (partition by subject_id, device_id, run)")
def _(spark, d):
    runs = islands(sensor(spark, d), ST, ORD, "day", ["p4", "p5", "ts_s"], lambda p: (p("p4") != F.col("p4")) | (p("p5") != F.col("p5")) | (F.col("ts_s") - p("ts_s") > 60), "run")
    spans = runs.groupBy(*ST, "run").agg((F.max("ts_s") - F.min("ts_s")).alias("_sec"))
    return runs.join(spans, [*ST, "run"]).select("row_id", F.when(F.col("p4") + F.col("p5") > 0, F.col("_sec")).otherwise(0).alias("seconds"))


@query("H08_constant_runs", f"with {_CONST} select subject_id, device_id, value, first_s, seconds, n from runs where n > 1")
def _(spark, d):
    return constant_runs(spark, d).where("n > 1").drop("run")


@query("H09_zero_runs", f"with {PLACED}, f as (select *, temperature = 0 as z, row_number() over (partition by subject_id, device_id, session order by ts_s, row_id) as place from placed) select row_id, case when place <= 3 then 'start_sentinel' else 'dropout_run' end as kind from f where z")
def _(spark, d):
    w = Window.partitionBy(*ST, "session").orderBy(*ORD)
    rows = placed(spark, d).withColumn("_i", F.row_number().over(w)).where("temperature = 0")
    return rows.select("row_id", F.when(F.col("_i") <= 3, "start_sentinel").otherwise("dropout_run").alias("kind"))


_VAL = f"{SENSOR}, v as (select *, temperature - lag(temperature) over w as jump, lead(temperature) over w - temperature as next_jump, ts_s - lag(ts_s) over w as dt from s where temperature between 1 and 59 window w as (partition by subject_id, device_id order by ts_s, row_id))"


@query("H11_jumps", f"with {_VAL} select case when dt <= 5 then 'near' else 'far' end as class, count(*) as n, count(*) filter (where abs(jump) >= 10) as jumps, count(*) filter (where abs(jump) >= 5 and abs(next_jump) >= 5 and sign(jump) <> sign(next_jump)) as spikes from v where jump is not null group by 1")
def _(spark, d):
    v = sensor(spark, d).where("temperature between 1 and 59")
    v = neighbour(neighbour(v, ST, ORD, "day", ["temperature", "ts_s"], "_p"), ST, ORD, "day", ["temperature"], "_n", ahead=True)
    v = v.select((F.col("temperature") - F.col("_p.temperature")).alias("jump"), (F.col("_n.temperature") - F.col("temperature")).alias("nj"), (F.col("ts_s") - F.col("_p.ts_s")).alias("dt")).where("jump is not null")
    spike = (F.abs("jump") >= 5) & (F.abs("nj") >= 5) & (F.signum("jump") != F.signum("nj"))
    return v.groupBy(F.when(F.col("dt") <= 5, "near").otherwise("far").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.abs("jump") >= 10).alias("jumps"), F.count_if(spike).alias("spikes"))


@query("H12_deltas", f"with {PLACED}, l as ({_LONG}), dl as (select *, p - lag(p) over w as dp, ts_s - lag(ts_s) over w as dt from l window w as (partition by subject_id, device_id, channel order by ts_s, row_id)) select channel, count(*) as n, quantile_cont(abs(dp), 0.5) as median, quantile_cont(abs(dp), 0.95) as q95, count(*) filter (where abs(dp) >= 3000) as extreme from dl where dt <= 5 group by 1")
def _(spark, d):
    rows = neighbour(sensor(spark, d), ST, ORD, "day", ["ts_s", *P], "_b").where(F.col("ts_s") - F.col("_b.ts_s") <= 5)
    x = rows.select(F.posexplode(F.array(*[F.abs(F.col(c) - F.col("_b")[c]) for c in P])).alias("channel", "x"))
    return x.groupBy((F.col("channel") + 1).alias("channel")).agg(F.count("*").alias("n"), F.percentile("x", 0.5).alias("median"), F.percentile("x", 0.95).alias("q95"), F.count_if(F.col("x") >= 3_000).alias("extreme"))


@query("H13_change", f"with {SENSOR}, c as (select row_id, p1 + p2 + p3 + p4 + p5 + p6 as total, case when ts_s - lag(ts_s) over w <= 5 then {' + '.join(f'abs({c} - lag({c}) over w)' for c in P)} end as change from s window w as (partition by subject_id, device_id order by ts_s, row_id)) select * from c")
def _(spark, d):
    rows = neighbour(sensor(spark, d), ST, ORD, "day", ["ts_s", *P], "_b")
    change = F.aggregate(F.zip_with(F.array(*P), F.array(*[F.col("_b")[c] for c in P]), lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("row_id", quality.total([F.col(c) for c in P]).alias("total"), F.when(F.col("ts_s") - F.col("_b.ts_s") <= 5, change).alias("change"))


_DOM = "case when greatest(p1, p2, p3, p4, p5, p6) > 0 then list_position([p1, p2, p3, p4, p5, p6], greatest(p1, p2, p3, p4, p5, p6)) - 1 else -1 end"


@query("H14_activity", f"with {SENSOR}, q as (select *, {_DOM} as dom from s), w as (select *, lag(dom) over (partition by subject_id, device_id order by ts_s, row_id) as before, ts_s - lag(ts_s) over (partition by subject_id, device_id order by ts_s, row_id) as dt from q) select subject_id, device_id, count(*) filter (where dt <= 5 and dom >= 0 and before >= 0 and dom <> before) as switches, count(*) filter (where dom >= 0) as loaded from w group by 1, 2")
def _(spark, d):
    rows = sensor(spark, d).withColumn("dom", quality.dominant(F.array(*P)))
    rows = neighbour(rows, ST, ORD, "day", ["dom", "ts_s"], "_b")
    b = F.col("_b.dom")
    return rows.groupBy(*ST).agg(F.count_if((F.col("ts_s") - F.col("_b.ts_s") <= 5) & (F.col("dom") >= 0) & (b >= 0) & (F.col("dom") != b)).alias("switches"), F.count_if(F.col("dom") >= 0).alias("loaded"))


@query("H15_places", f"with {SENSOR} select row_id, row_number() over (partition by file_no order by row_id) - 1 as place, count(*) over (partition by file_no) as size from s")
def _(spark, d):
    return sensor(spark, d).select("row_id", (F.row_number().over(Window.partitionBy("file_no").orderBy("row_id")) - 1).alias("place"), F.count("*").over(Window.partitionBy("file_no")).alias("size"))


@query("H16_time_conflicts", f"with {SENSOR} select subject_id, device_id, ts_s, count(*) as n, max(temperature) - min(temperature) as t_range, max(humidity) - min(humidity) as h_range from s group by 1, 2, 3 having count(distinct (temperature, humidity)) > 1")
def _(spark, d):
    g = sensor(spark, d).groupBy(*ST, "ts_s").agg(F.count("*").alias("n"), (F.max("temperature") - F.min("temperature")).alias("t_range"), (F.max("humidity") - F.min("humidity")).alias("h_range"))
    return g.where("t_range > 0 or h_range > 0")


@query("H17_night_ordinal", f"with {SENSOR} select distinct subject_id, night, dense_rank() over (partition by subject_id order by night) as ordinal from s")
def _(spark, d):
    return series.ordinals(sensor(spark, d))


@query("H18_rolling", f"with {SENSOR}, n as (select subject_id, night, avg(temperature) as m from s group by all) select subject_id, night, round(avg(m) over (partition by subject_id order by night rows between 3 preceding and 3 following), 6) as rolling from n")
def _(spark, d):
    n = sensor(spark, d).groupBy("subject_id", "night").agg(F.avg("temperature").alias("m"))
    return n.select("subject_id", "night", F.round(F.avg("m").over(Window.partitionBy("subject_id").orderBy("night").rowsBetween(-3, 3)), 6).alias("rolling"))


@query("H19_longest_run", f"with {PLACED}, c as (select subject_id, device_id, segment, max(ts_s) - min(ts_s) as seconds from placed group by all) select subject_id, device_id, max(seconds) as longest_s from c group by 1, 2")
def _(spark, d):
    c = placed(spark, d).groupBy(*ST, "segment").agg((F.max("ts_s") - F.min("ts_s")).alias("seconds"))
    return c.groupBy(*ST).agg(F.max("seconds").alias("longest_s"))


_UNIT = f"{SENSOR}, u as (select subject_id, row_number() over (partition by subject_id order by night) as k, avg(p1) as x from s group by subject_id, night)"


def units(spark, d) -> DataFrame:
    """One value a night and subject: night tables are bounded by the calendar."""
    n = sensor(spark, d).groupBy("subject_id", "night").agg(F.avg("p1").alias("x"))
    return n.select("subject_id", F.row_number().over(Window.partitionBy("subject_id").orderBy("night")).alias("k"), "x")


_SCORE = f"{_UNIT}, sc as (select *, quantile_cont(x, 0.5) over (partition by subject_id order by k rows between current row and 3 following) - quantile_cont(x, 0.5) over (partition by subject_id order by k rows between 4 preceding and 1 preceding) as diff, count(*) over (partition by subject_id order by k rows between current row and 3 following) as na, count(*) over (partition by subject_id order by k rows between 4 preceding and 1 preceding) as nb from u), score as (select subject_id, k, round(diff, 6) as score from sc where na = 4 and nb = 4)"


@query("H20_split_score", f"with {_SCORE} select * from score")
def _(spark, d):
    return series.split_scores(units(spark, d), 4)


@query("H21_split_rank", f"with {_SCORE} select subject_id, k, row_number() over (partition by subject_id order by abs(score) desc, k) as rk from score")
def _(spark, d):
    return series.split_scores(units(spark, d), 4).select("subject_id", "k", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc(F.abs("score")), "k")).alias("rk"))


@query("H22_distinct_peaks")
def _(spark, d):
    return series.distinct_peaks(series.split_scores(units(spark, d), 4), 3, 4)


@query("H23_best_split", f"with {_UNIT}, c as (select a.subject_id, a.k, sum(case when b.k < a.k then b.x end) as s1, count(case when b.k < a.k then 1 end) as n1, sum(case when b.k >= a.k then b.x end) as s2, count(case when b.k >= a.k then 1 end) as n2 from u a join u b using (subject_id) group by 1, 2), g as (select subject_id, k, s1 * s1 / n1 + s2 * s2 / n2 as gain from c where n1 > 0) select subject_id, arg_max(k, (gain, -k)) as best_k from g group by 1")
def _(spark, d):
    return series.best_split(units(spark, d))


@query("H24_recovery", f"with {_UNIT}, m as (select subject_id, avg(x) filter (where k <= 8) as pre, avg(x) filter (where k between 9 and 16) as early, avg(x) filter (where k > 16) as late from u group by 1) select subject_id, case when pre = early then 'none' when (early - late) / (early - pre) >= 0.8 then 'recovered' when (early - late) / (early - pre) >= 0.3 then 'partial' else 'kept' end as recovery from m")
def _(spark, d):
    at = lambda c: F.avg(F.when(c, F.col("x")))
    k = F.col("k")
    m = units(spark, d).groupBy("subject_id").agg(at(k <= 8).alias("pre"), at(k.between(9, 16)).alias("early"), at(k > 16).alias("late"))
    back = F.try_divide(F.col("early") - F.col("late"), F.col("early") - F.col("pre"))
    return m.select("subject_id", F.when(F.col("pre") == F.col("early"), "none").when(back >= 0.8, "recovered").when(back >= 0.3, "partial").otherwise("kept").alias("recovery"))


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
