"""Scalar functions on log text, times and numbers: all of them built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Movement labels of an event's last word.
MOVEMENTS = ("LM", "RM", "UM", "DM", "NM")


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


# Marks of a crash dump, and the words that make an event a control event.
CRASH_MARKERS = ("Guru Meditation", "Backtrace", "register dump", "EXCVADDR", "EXCCAUSE", "PC      :", "ELF file SHA256", "Rebooting", "rst:0x", "LBEG", "SAR     :")
CONTROL_WORDS = ("EVENT:", "AHON", "AHOF", "BHSDOWN", "BHNTSDOWN", "BCSUP", "FON", "FOF", "FOH", "STEMP", "SLIMIT", "SMINLIMIT", "SCHATIDS", "AMODE", "AIHON", "AIHOFF", "AIDONE", "MMODE", "MON", "MOF", "WSTOP")
# Line kinds in order, each with the pattern of the trimmed line that makes it.
LINE_KINDS = (
    ("blank", r"^$"), ("data", r"^(\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}(:\d{2})?|\d{2}-\d{2} \d{2}:\d{2}:\d{2})[,.;\t]"), ("empty_csv_row", r"^,+$"), ("json_struct", r'^([{}"]|[}"],)$'),
    ("json_chunk_key", r'^"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"\s*:\s*[{]'), ("json_root_key", r'^"[a-z]+(_\d+)?"\s*:\s*[{]'), ("nvs_log", r"^\[NVS\]"),
    ("crash_dump", r"^A\d+\s+:|" + "|".join(CRASH_MARKERS)), ("malformed_data", r'^("csvData"\s*:\s*")?\d{2,4}-\d{2}'))


def line_kind(line: Column) -> Column:
    """Kind of a physical line; the first rule that applies counts, anything else is of the device's log."""
    t = F.coalesce(F.btrim(line, F.lit(" \t\r\n")), F.lit(""))
    hits = F.filter(F.array(*[F.when(t.rlike(pattern), kind) for kind, pattern in LINE_KINDS]), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, 0), F.lit("device_log"))


def is_control(event: Column) -> Column:
    """Does an event's text contain a control word?"""
    return event.rlike("|".join(CONTROL_WORDS))


def parse_time(text: Column, year: Column) -> Column:
    """Epoch seconds of the three written forms (full, without seconds, without year); null for no real time."""
    full = r"^(\d{4})-(\d{2})-(\d{2}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?=[,.;\t]|$)"
    short = r"^(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})(?=[,.;\t]|$)"
    g = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("int")
    y, mo, d = F.coalesce(g(full, 1), F.when(text.rlike(short), year)), F.coalesce(g(full, 2), g(short, 1)), F.coalesce(g(full, 3), g(short, 2))
    h, mi, s = F.coalesce(g(full, 4), g(short, 3)), F.coalesce(g(full, 5), g(short, 4)), F.coalesce(g(full, 6), g(short, 5), F.lit(0))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    return F.when((h < 24) & (mi < 60) & (s < 60) & y.isNotNull(), F.unix_date(date).cast("long") * 86_400 + h * 3_600 + mi * 60 + s)


def infer_year(month: Column, anchor_year: Column, anchor_month: Column, hint: Column) -> Column:
    """Year of a date without one: the anchor's, one less or more where the months lie more than six apart; else the hint."""
    return F.when(month - anchor_month > 6, anchor_year - 1).when(anchor_month - month > 6, anchor_year + 1).when(anchor_year.isNotNull(), anchor_year).otherwise(hint)


def numbers(body: Column, sep: str) -> Column:
    """Leading numeric values of a line body as an array of doubles."""
    parts = F.split(body, sep)
    plain = lambda x: F.when(F.trim(x).rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), F.trim(x).try_cast("double"))
    return F.filter(F.transform(parts, plain), lambda x: x.isNotNull())


def value_schema(n: Column) -> Column:
    return F.when(n == 8, "p6_t_h").when(n == 9, "dev_p6_t_h").otherwise(F.concat(F.lit("nonstandard_"), n.cast("string")))


def movement(event: Column) -> Column:
    """The last word of an event if it is a movement label, else an empty text."""
    last = F.element_at(F.split(F.trim(event), r"\s+"), -1)
    return F.when(last.isin(*MOVEMENTS), last).otherwise("")


def control_codes(event: Column) -> Column:
    """All other words of an event."""
    words = F.filter(F.split(F.trim(event), r"\s+"), lambda x: x != "")
    return F.when(movement(event) != "", F.slice(words, 1, F.size(words) - 1)).otherwise(words)


def redact(text: Column, digits: int = 8) -> Column:
    return F.regexp_replace(text, f"[0-9]{{{digits},}}", "<redacted>")


def file_id(path: Column) -> Column:
    return F.concat(F.lit("rf_"), F.substring(F.sha1(path), 1, 10))


def night(ts_s: Column) -> Column:
    """Number of the night: days of the time twelve hours earlier."""
    return div(ts_s - 43_200, 86_400)


def date_of(ts_s: Column) -> Column:
    return F.date_from_unix_date(div(ts_s, 86_400).cast("int"))


def night_id(ts_s: Column) -> Column:
    return F.date_from_unix_date(night(ts_s).cast("int")).cast("string")


def season(date: Column) -> Column:
    """Year and season; January and February belong to the winter that began in December, so two months back every season is a quarter."""
    begun = F.add_months(date, -2)
    return F.concat_ws("-", F.year(begun), F.get(F.array(*[F.lit(x) for x in ("spring", "summer", "autumn", "winter")]), F.quarter(begun) - 1))


def noon_hour(ts_s: Column) -> Column:
    """Hours since the last noon, so that a night does not wrap."""
    return F.pmod((ts_s % 86_400) / 3_600.0 - 12, F.lit(24.0))


def night_key(ts_s: Column, anchor: Column) -> Column:
    """D#### of a time, counted in nights from an anchor."""
    return F.concat(F.lit("D"), F.lpad((div(ts_s - 43_200 - anchor, 86_400) + 1).cast("string"), 4, "0"))


def relative(seconds: Column) -> Column:
    """D#### HH:MM:SS of a number of seconds, the first day being D0001; null before it."""
    clock = [F.lpad(F.pmod(div(seconds, unit), F.lit(base)).cast("string"), 2, "0") for unit, base in ((3_600, 24), (60, 60), (1, 60))]
    return F.when(seconds >= 0, F.concat(F.lit("D"), F.lpad((div(seconds, 86_400) + 1).cast("string"), 4, "0"), F.lit(" "), F.concat_ws(":", *clock)))


def relative_seconds(text: Column) -> Column:
    """Seconds of a relative time; null for any other text."""
    parts = F.transform(F.split(F.substr(text, F.lit(2)), "[ :]"), lambda x: x.cast("long"))
    units = F.array(*[F.lit(u).cast("long") for u in (86_400, 3_600, 60, 1)])
    total = F.aggregate(F.zip_with(parts, units, lambda n, u: n * u), F.lit(-86_400).cast("long"), lambda s, x: s + x)
    return F.when(text.rlike(r"^D\d{4} \d{2}:\d{2}:\d{2}$"), total)


GAP_EDGES = (0, 10, 60, 300, 1_800, 7_200)


def gap_bin(delta: Column, edges: tuple[int, ...] = GAP_EDGES) -> Column:
    """Label of the bin of a gap in seconds; its place is the number of edges below it."""
    labels = [f"{low}-{high}s" for low, high in zip(edges, edges[1:], strict=False)] + [f">{edges[-1]}s"]
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < delta))
    return F.when(delta < 0, "overlap").when(delta.isNotNull(), F.get(F.array(*[F.lit(x) for x in labels]), F.greatest(below - 1, F.lit(0))))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def typographic(x: Column, digits: int) -> Column:
    """A number for print, with the minus sign of typography."""
    return F.replace(F.format_string(f"%.{digits}f", x), F.lit("-"), F.lit("−"))
