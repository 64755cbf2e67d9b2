"""Mixed timestamp formats and time zones, normalised to microseconds since 1970 UTC.

Every form is one alternative of a single regular expression with named groups.  One pass over the text extracts all
components (the replacement template names the groups), the calendar is checked on integers, days are counted by the
proleptic Gregorian day formula, and zone rules are applied last.  Everything stays inside generated JVM code.
"""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# English month names, and zone names with their usual offsets from UTC in minutes.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "KST": 540, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "HKT": 480, "SGT": 480, "ICT": 420, "PKT": 300,
    "SAST": 120, "CAT": 120, "EAT": 180, "WAT": 60, "BRT": -180, "ART": -180, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "AKST": -540, "AKDT": -480, "HST": -600,
}

_MON = "(?:" + "|".join(MONTHS) + ")[a-z]*"
_DATE = "|".join([
    r"(?<y1>\d{4})-(?<m1>\d{1,2})-(?<d1>\d{1,2})",
    r"(?<m2>\d{1,2})-(?<d2>\d{1,2})",
    r"(?<a3>\d{1,2})/(?<b3>\d{1,2})/(?<y3>\d{4})",
    r"(?<y7>\d{4})/(?<m7>\d{1,2})/(?<d7>\d{1,2})",
    r"(?<y4>\d{4})년\s*(?<m4>\d{1,2})월\s*(?<d4>\d{1,2})일",
    rf"(?<n5>{_MON})\.?\s+(?<d5>\d{{1,2}}),?\s+(?<y5>\d{{4}})",
    rf"(?<d6>\d{{1,2}})\.?\s+(?<n6>{_MON})\.?,?\s+(?<y6>\d{{4}})",
])
_TIME = r"(?:(?<kp>오전|오후)\s*)?(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?(?:\s*(?<ap>[ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?:\s*(?<zo>[+-]\d{2}(?::?\d{2})?)|\s*(?<zn>z|[a-z]{2,5}|[a-z]+/[a-z0-9_+\-/]+))?"
_EPOCH = r"(?<e>\d{10}|\d{13}|\d{16})(?:\.(?<ef>\d+))?"
PATTERN = rf"(?i)^[\p{{Z}}\s\x{{FEFF}}]*(?:(?:{_DATE})(?:T|\s+){_TIME}{_ZONE}|{_EPOCH})[\p{{Z}}\s]*$"
# Of the alternatives one takes part, so groups of the same meaning stand side by side in the template.
_PARTS = ["y1 y3 y7 y4 y5 y6", "m1 m2 m7 m4", "n5 n6", "d1 d2 d7 d4 d5 d6", "a3", "b3", "h", "mi", "s", "f", "kp ap", "zo", "zn", "e", "ef"]
_MARK = "\u0001"
_TEMPLATE = _MARK + _MARK.join("".join("${" + g + "}" for g in p.split()) for p in _PARTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 by whole-number arithmetic (years counted from March)."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    yy = y - F.when(m <= 2, 1).otherwise(0)
    shifted = F.pmod(m + 9, F.lit(12))
    return 365 * yy + div(yy, 4) - div(yy, 100) + div(yy, 400) + div(153 * shifted + 2, 5) + d - 1 - 719_468


def valid_date(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= length)


@cache
def zone_ids() -> list[str]:
    """Names of the zones whose rules the engine has: region names, and the names without region that the project's files may use."""
    return sorted(zoneinfo.available_timezones())


def region(name: Column) -> Column:
    """The zone that a name means, whatever its letter case; null for an unknown one."""
    ids = zone_ids()
    folded = F.create_map(*[F.lit(x) for i in ids if "/" in i for x in (i.lower(), i)])
    return F.when(name.isin(ids), name).when(F.lower(name).isin([i.lower() for i in ids if "/" in i]), F.try_element_at(folded, F.lower(name)))


def _once(x: Column) -> Column:
    """Keep x as a column of its own: a later filter must not copy its expression into itself."""
    return F.when(F.spark_partition_id() >= 0, x)


def components(df: DataFrame, text: str) -> DataFrame:
    """Add the integers that `text` spells out: _y _m _d (where the form fixes them), _a _b (slash dates), _h _half _mi _s
    _us, _off (minutes, where the text has an offset or abbreviation), _region (where it names one), _zoned, _nameless (no year) and _epoch (bare numbers, microseconds)."""
    raw = F.regexp_replace(F.col(text), PATTERN, _TEMPLATE)
    df = df.withColumn("_raw", _once(raw)).withColumn("_g", _once(F.when(F.col("_raw").startswith(_MARK), F.split("_raw", _MARK)))).drop("_raw")
    y, m, name, d, a, b, h, mi, s, f, half, zo, zn, e, ef = (F.col("_g")[i + 1] for i in range(len(_PARTS)))
    num = lambda x: F.when(x != "", x.cast("int"))
    month_name = F.when(name != "", F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int"))
    sign = F.when(zo.startswith("-"), -1).otherwise(1)
    digits = F.translate(zo, "+-:", "")
    minutes = F.coalesce(num(F.substring(digits, 3, 2)), F.lit(0))
    offset = F.when((zo != "") & (minutes < 60), sign * (F.substring(digits, 1, 2).cast("int") * 60 + minutes))
    names = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
    abbreviation = F.when((zn != "") & ~F.contains(zn, F.lit("/")), F.try_element_at(names, F.upper(zn)))
    scale = F.when(F.length(e) == 10, 6).when(F.length(e) == 13, 3).otherwise(0)
    # In several steps, each small enough to be compiled as a whole.
    steps: list[dict[str, Column]] = [
        {"_y": num(y), "_m": F.coalesce(num(m), month_name), "_d": num(d), "_a": num(a), "_b": num(b), "_nameless": (y == "") & (m != "")},
        {"_h": num(h), "_half": F.when(half == "", None).when((half == "오전") | (F.lower(half) == "a"), 0).otherwise(1), "_mi": num(mi), "_s": F.coalesce(num(s), F.lit(0)),
         "_us": F.when(f == "", 0).otherwise(F.substring(F.rpad(f, 9, "0"), 1, 6).cast("int"))},
        {"_off": F.coalesce(offset, abbreviation), "_region": F.when(F.contains(zn, F.lit("/")), region(zn)), "_zoned": (zo != "") | (zn != ""),
         "_epoch": F.when(e != "", F.concat(e, F.substring(F.rpad(ef, 6, "0"), F.lit(1), scale)).try_cast("long"))},
    ]
    for step in steps:
        df = df.withColumns({k: _once(v) for k, v in step.items()})
    return df.drop("_g")


def instants(df: DataFrame, day_first: str, zone: str, chunk_key: str, year_hint: str, out: str) -> DataFrame:
    """Add `out`, the instant of the `components` in microseconds since 1970 UTC, null where they name none.

    day_first: column 'dmy' or 'mdy' for dates with slashes; zone: column with the zone of local times, a
    name that `region` gives; chunk_key: local
    YYYY-MM-DD_HH-MM-SS near the row, source of a missing year; year_hint: the year to take where there is no chunk key.
    Defined cases: null, empty and unknown texts, dates not on the calendar, local times without zone or in a gap of
    their zone give null; repeated local times give the earlier instant; unknown zone names give null.  A zone in the text
    counts before that of the column, as an offset, an abbreviation with its usual offset, or a region with its rules.
    """
    own = [c for c in df.columns if c not in {"_y", "_m", "_d", "_a", "_b", "_h", "_half", "_mi", "_s", "_us", "_off", "_region", "_zoned", "_nameless", "_epoch"}]
    dmy, mdy = F.col(day_first) == "dmy", F.col(day_first) == "mdy"
    month = F.coalesce(F.col("_m"), F.when(dmy, F.col("_b")).when(mdy, F.col("_a")))
    day = F.coalesce(F.col("_d"), F.when(dmy, F.col("_a")).when(mdy, F.col("_b")))
    key_y = F.nullif(F.regexp_extract(chunk_key, r"^\s*(\d{4})-(\d{2})-", 1), F.lit("")).cast("int")
    key_m = F.nullif(F.regexp_extract(chunk_key, r"^\s*(\d{4})-(\d{2})-", 2), F.lit("")).cast("int")
    df = df.withColumns({"_m": _once(month), "_d": _once(day), "_ky": _once(key_y), "_km": _once(F.when(key_m.between(1, 12), key_m))})
    m, km, ky = F.col("_m"), F.col("_km"), F.col("_ky")
    near = F.when(m - km > 6, ky - 1).when(km - m > 6, ky + 1).when(km.isNotNull(), ky)
    hour = F.when(F.col("_half").isNull(), F.when(F.col("_h") < 24, F.col("_h"))).when(F.col("_h").between(1, 12), F.col("_h") % 12 + 12 * F.col("_half"))
    df = df.withColumns({"_y": _once(F.when(F.col("_nameless"), F.coalesce(near, F.col(year_hint).cast("int"))).otherwise(F.col("_y"))), "_h": _once(hour)})
    y, d, h = F.col("_y"), F.col("_d"), F.col("_h")
    ok = valid_date(y, m, d) & h.isNotNull() & (F.col("_mi") < 60) & (F.col("_s") < 60)
    local = F.when(ok, (((days_from_civil(y, m, d).cast("long") * 24 + h) * 60 + F.col("_mi")) * 60 + F.col("_s")) * 1_000_000 + F.col("_us"))
    # Zone rules: an unknown name must not raise, a repeated local time means the earlier instant, a skipped one none.
    known = F.when(F.col("_epoch").isNull() & F.col("_off").isNull(), F.when(F.col("_zoned"), F.col("_region")).otherwise(F.col(zone)))
    df = df.withColumns({"_local": _once(local), "_known": _once(known)})
    stamp = F.timestamp_micros(F.col("_local"))
    df = df.withColumn("_at", _once(F.to_utc_timestamp(stamp, F.col("_known"))))
    ruled = F.when(F.from_utc_timestamp(F.col("_at"), F.col("_known")) == stamp, F.unix_micros(F.col("_at")))
    by_rule = F.when(F.col("_off").isNotNull(), F.col("_local") - F.col("_off").cast("long") * 60_000_000).otherwise(ruled)
    return df.select(*own, _once(F.when(F.col("_epoch").isNotNull(), F.col("_epoch")).otherwise(by_rule)).alias(out))


def normalise(df: DataFrame, text: str, day_first: str, zone: str, chunk_key: str, year_hint: str, out: str) -> DataFrame:
    df = df.withColumn(zone, region(F.col(zone)))
    return instants(components(df, text), day_first, zone, chunk_key, year_hint, out)


def found(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, utc_us) of every row whose time names one instant; a file listed twice counts once."""
    one = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("uploaded_at", "log_zone", "date_order", "year_hint")).alias("_f"))
    one = one.select(F.col("file_id").alias("_file"), region(F.col("_f.log_zone")).alias("log_zone"), "_f.date_order", "_f.year_hint")
    slim = components(rows.select("row_id", "file_id", "ts_raw", "chunk_key"), "ts_raw").drop("ts_raw")
    with_file = slim.join(one, slim["file_id"] == one["_file"], "left")
    return instants(with_file, "date_order", "log_zone", "chunk_key", "year_hint", "utc_us").where(F.col("utc_us").isNotNull()).select("row_id", "utc_us")
