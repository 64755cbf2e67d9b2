"""Queries of the general data-processing operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.operators import drift, grid, instants, rejects, sessions, spikes
from brackwater.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names])


def _rounded_grid(rows: DataFrame, specs: DataFrame) -> DataFrame:
    grid_rows = grid.regular(rows, specs)
    return grid_rows.select("subject_id", "device_id", "bin_start_s", "state", *[F.round(c, 6).alias(c) for c in grid.CHANNELS])


def queries() -> dict[str, Query]:
    return {
        "p2_found": _over(rejects.found, "raw_lines", "log_files", "field_aliases"),
        "p2_loaded": _over(rejects.loaded, "raw_lines", "log_files", "field_aliases"),
        "p3_found": _over(spikes.found, "sensor_rows"),
        "p4_found": _over(sessions.found, "windows"),
        "p5_found": _over(instants.found, "data_rows", "log_files"),
        "p6_found": _over(drift.changes, "log_files", "field_aliases"),
        "p6_table": _over(drift.ingest, "raw_lines", "log_files", "field_aliases"),
        "p6_promoted": _over(drift.promoted, "raw_lines", "log_files", "field_aliases"),
        "p7_found": _over(grid.found, "sensor_rows", "window_specs"),
        "p7_grid": _over(_rounded_grid, "sensor_rows", "window_specs"),
    }


# Header in force, fields and types of every file; lines cut at the separator outside quotes.
_BLANK = f"[{rejects.BLANKS}]"
_SEPARATORS = ((",", ","), (";", ";"), ("\t", "\\t"))


def _outer(s: str) -> str:
    return _BLANK.replace("\t", "") if s == "\\t" else _BLANK


_CELL = "<S>(?:{B}*\"(?:[^\"]|\"\")*\"{B}*|[^<S>\"]*)"


def _cut(call: str) -> str:
    return "case sep " + " ".join(f"when {'chr(9)' if c == chr(9) else repr(c)} then " + call.replace("<CELL>", _CELL.replace("{B}", _outer(s))).replace("<S>", s).replace("{B}", _outer(s)).replace("{W}", rejects.BLANKS) for c, s in _SEPARATORS) + " end"


_LINES = f"""
f as (select distinct on (file_id) * from log_files where file_id is not null order by file_id, uploaded_at nulls first),
o as (select file_id, sep, last_value(case when headers is not null then {{{{'h': headers, 't': field_types}}}} end ignore nulls) over (partition by source_id order by coalesce(epoch_us(uploaded_at), 0), file_id rows unbounded preceding) as force from f),
h as (select file_id, sep, unnest(string_split(force.h, sep)) as raw, unnest(string_split(force.t, ',')) as type, generate_subscripts(string_split(force.h, sep), 1) as pos from o where force is not null),
n as (select h.*, lower(trim(trim(replace(trim(raw), chr(65279), ''), '"'))) as name from h),
y as (select file_id, any_value(sep) as sep, list(coalesce(a.field, n.name) order by pos) as fields, list(lower(trim(type)) order by pos) as types from n left join field_aliases a on a.alias = n.name group by 1),
l as (select line_id, file_id, line_no, sep, fields, types, {_cut("regexp_replace(regexp_replace(line, '^{B}+|{B}+$', '', 'g'), '^[{W}]+', '')")} as line from raw_lines join y using (file_id)
  where regexp_matches(line, '^[\\s\\pZ]*\\d{{2,4}}-\\d{{2}}')),
m as (select *, regexp_extract(line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?|\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}})') as tm from l),
r as (select *, substr(line, length(tm) + 1) as rest, try_cast(case when substr(tm, 3, 1) = '-' then '2000-' || tm when length(tm) - length(replace(tm, ':', '')) = 1 then tm || ':00' else tm end as timestamp) as at_, tm like '% 24:%' as late from m),
w as (select *, {_cut("regexp_full_match(rest, '(?:<CELL>)*')")} as whole,
  {_cut("list_transform(regexp_extract_all(rest, '<CELL>'), lambda x: regexp_replace(regexp_replace(x[2:], '^{B}+|{B}+$', '', 'g'), '^\"(.*)\"$', '\\1', 's'))")} as cells from r),
v as (select *, list_transform(cells, lambda x: regexp_replace(x, '^[{rejects.BLANKS}]+|[{rejects.BLANKS}]+$', '', 'g')) as got from w),
c as (select *, list_transform(range(2, len(fields) + 1), lambda i: case when got[i - 1] = '' or got[i - 1] is null or types[i] not in ('int', 'decimal') then 0
    when not regexp_full_match(got[i - 1], case types[i] when 'int' then '-?[0-9]+' else '-?[0-9]+([.][0-9]+)?' end) then 2
    when fields[i] in ('p1', 'p2', 'p3', 'p4', 'p5', 'p6') and try_cast(got[i - 1] as double) not between 0 and 4095 or fields[i] = 'temp' and try_cast(got[i - 1] as double) not between -10 and 60
      or fields[i] = 'humid' and try_cast(got[i - 1] as double) not between 0 and 100 then 1 else 0 end) as faults from v)""".replace("{{", "{").replace("}}", "}")


_READINGS = """
readings as (
  select subject_id, device_id, w.bin_s, w.max_gap_s, epoch_us(ts) as us
  from sensor_rows s join window_specs w using (spec_code)
  where ts is not null and coalesce(p1, p2, p3, p4, p5, p6, temp, humid) is not null)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""with {_LINES},
x as (select line_id, case when at_ is null or late then 'bad_time' when not starts_with(rest, sep) then 'bad_separator' when not whole then 'broken_quote' when len(cells) + 1 <> len(fields) then 'wrong_count'
  when list_contains(faults, 2) then 'bad_value' when list_contains(faults, 1) then 'out_of_range' end as reason from c)
select line_id, reason from x where reason is not null""",
        "p4_found": """
with s as (
  select distinct subject_id, device_id, coalesce(t0, epoch(try_strptime(split_part(prov, '|', 3), '%Y-%m-%d %H:%M:%S'))::bigint) as s from windows),
d as (select *, case when s - lag(s) over (partition by subject_id, device_id order by s) <= 1800 then 0 else 1 end as fresh from s where s is not null),
g as (select *, sum(fresh) over (partition by subject_id, device_id order by s rows unbounded preceding) as no from d)
select subject_id, device_id, min(s) as start_s, max(s) as end_s, count(*) as n_windows from g group by subject_id, device_id, no""",
        "p6_found": """
with f as (select distinct on (file_id) * from log_files where headers is not null),
o as (select file_id, sep, headers, field_types, lag(file_id) over (partition by source_id order by uploaded_at, file_id) as before from f),
h as (
  select file_id, unnest(string_split(headers, sep)) as raw, unnest(string_split(field_types, ',')) as type from f),
n as (
  select file_id, type, lower(trim(trim(replace(trim(raw), chr(65279), ''), '"'))) as name from h),
k as (select n.file_id, n.name, n.type, coalesce(a.field, n.name) as field from n left join field_aliases a on a.alias = n.name),
b as (
  select coalesce(x.file_id, y.file_id) as file_id, coalesce(x.field, y.field) as field, x.name as xn, y.name as yn, x.type as xt, y.type as yt
  from (select o.file_id, field, name, type from o join k using (file_id) where before is not null) x
  full join (select o.file_id, field, name, type from o join k on k.file_id = o.before) y on x.file_id = y.file_id and x.field = y.field)
select file_id, 'added' as change_kind, field from b where yn is null
union all select file_id, 'removed', field from b where xn is null
union all select file_id, 'renamed', field from b where xn <> yn
union all select file_id, 'retyped', field from b where xt <> yt""",
        "p7_found": f"""
with {_READINGS},
o as (select *, lead(us) over (partition by subject_id, device_id order by us) as later from readings),
b as (select *, us // (bin_s * 1000000) as k, later // (bin_s * 1000000) as k2 from o where later - us <= 1800000000)
select subject_id, device_id, (k + 1) * bin_s as from_s, k2 * bin_s as to_s,
  case when (k2 - k - 1) * bin_s <= max_gap_s then 'filled' else 'missing' end as state
from b where k2 - k > 1""",
        "p7_grid": f"""
with r as (
  select subject_id, device_id, w.bin_s, w.max_gap_s, epoch_us(ts) as us, epoch_us(ts) // (w.bin_s * 1000000) as k, {", ".join(grid.CHANNELS)}
  from sensor_rows s join window_specs w using (spec_code) where ts is not null and coalesce({", ".join(grid.CHANNELS)}) is not null),
b as (select subject_id, device_id, bin_s, max_gap_s, k, min(us) as lo, max(us) as hi, {", ".join(f"round(avg({c}), 6) as {c}" for c in grid.CHANNELS)} from r group by 1, 2, 3, 4, 5),
n as (select *, lead(k) over w as k2, lead(lo) over w as lo2 from b window w as (partition by subject_id, device_id, bin_s, max_gap_s order by k)),
g as (select *, case when k2 - k > 1 and lo2 - hi <= 1800000000 then case when (k2 - k - 1) * bin_s <= max_gap_s then 'filled' else 'missing' end end as gap from n),
f as (select *, unnest(generate_series(k, case when gap is null then k else k2 - 1 end)) as kk from g),
x as (select *, case when kk = k then 'observed' else gap end as state from f)
select subject_id, device_id, kk * bin_s as bin_start_s, state, {", ".join(f"case when state <> 'missing' then {c} end as {c}" for c in grid.CHANNELS)} from x""",
    }
