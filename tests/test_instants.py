from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from brackwater.operators import instants

ROWS = "row_id long, file_id string, ts_raw string, chunk_key string, utc_us string"
FILES = "file_id string, uploaded_at timestamp_ntz, log_zone string, date_order string, year_hint int"
LISTED = [("utc", None, "UTC", "dmy", 2020), ("ny", None, "America/New_York", "mdy", None), ("de", None, "Europe/Berlin", "dmy", 2021), ("none", None, None, "dmy", None), ("odd", None, "Mars/Base", "dmy", None),
          ("utc", datetime(2030, 1, 1), "UTC", "mdy", 1999)]


def us(*a, zone=UTC):
    return int((datetime(*a, tzinfo=zone) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


CASES = [
    ("utc", "2024-02-29 1:02:03", None, us(2024, 2, 29, 1, 2, 3)), ("utc", "2023-02-29 01:02:03", None, None), ("utc", "2024-01-05 07:08", None, us(2024, 1, 5, 7, 8)),
    ("utc", "\t 2024-01-05 07:08:09,5  ", None, us(2024, 1, 5, 7, 8, 9, 500_000)), ("utc", "2024-01-05T07:08:09.123456Z", None, us(2024, 1, 5, 7, 8, 9, 123_456)),
    ("none", "2024-01-05T07:08:09+0530", None, us(2024, 1, 5, 1, 38, 9)), ("none", "2024-01-05T07:08:09-03", None, us(2024, 1, 5, 10, 8, 9)), ("none", "2024-01-05 07:08:09 KST", None, us(2024, 1, 4, 22, 8, 9)),
    ("none", "2024-01-05 07:08:09", None, None), ("odd", "2024-01-05 07:08:09", None, None), ("gone", "2024-01-05 07:08:09", None, None), ("gone", "2024-01-05 07:08:09Z", None, us(2024, 1, 5, 7, 8, 9)),
    ("ny", "2024-03-10 02:30:00", None, None), ("ny", "2024-11-03 01:30:00", None, us(2024, 11, 3, 5, 30)), ("ny", "2024-11-03 01:30:00 EST", None, us(2024, 11, 3, 6, 30)),
    ("ny", "03/04/2024 12:05:06 AM", None, us(2024, 3, 4, 5, 5, 6)), ("utc", "03/04/2024 12:05:06pm", None, us(2024, 4, 3, 12, 5, 6)), ("utc", "31/12/2024 1:05:06 p.m.", None, us(2024, 12, 31, 13, 5, 6)),
    ("utc", "13/13/2024 01:00:00", None, None), ("utc", "01/01/2024 13:00:00 PM", None, None), ("utc", "2024년 3월 4일 오전 12:00:01", None, us(2024, 3, 4, 0, 0, 1)), ("utc", "2024년 3월 4일 오후 3:00:01", None, us(2024, 3, 4, 15, 0, 1)),
    ("utc", "Oct 7, 2025 02:11:04", None, us(2025, 10, 7, 2, 11, 4)), ("utc", "7 Oct 2025 02:11:04", None, us(2025, 10, 7, 2, 11, 4)), ("utc", "1700000000", None, 1_700_000_000_000_000),
    ("none", "1700000000.25", None, 1_700_000_000_250_000), ("none", "1700000000123", None, 1_700_000_000_123_000), ("none", "1700000000123456", None, 1_700_000_000_123_456), ("utc", "170000000", None, None),
    ("utc", "12-31 23:59:59", "2025-01-01_00-00-10", us(2024, 12, 31, 23, 59, 59)), ("utc", "01-01 00:00:01", "2024-12-31_23-59-00", us(2025, 1, 1, 0, 0, 1)), ("utc", "06-01 00:00:01", None, us(2020, 6, 1, 0, 0, 1)),
    ("ny", "06-01 00:00:01", None, None), ("utc", "06-01 00:00:01", "nonsense", us(2020, 6, 1, 0, 0, 1)), ("utc", "2024-01-05 24:00:00", None, None), ("utc", "2024-01-05 23:60:00", None, None),
    ("none", "2024-03-01 10:00:00 Europe/Berlin", None, us(2024, 3, 1, 9)), ("utc", "2024-03-01 10:00:00 asia/seoul", None, us(2024, 3, 1, 1)), ("none", "2024-03-01 10:00:00 America/Argentina/Buenos_Aires", None, us(2024, 3, 1, 13)),
    ("none", "2024-03-31 02:30:00 Europe/Berlin", None, None), ("utc", "2024-03-01 10:00:00 Mars/Base", None, None), ("none", "2024-03-01 10:00 Etc/GMT+3", None, us(2024, 3, 1, 13)),
    ("utc", "", None, None), ("utc", "   ", None, None), ("utc", "unset", None, None), ("utc", None, None, None), (None, "2024-01-05 01:00:00Z", None, us(2024, 1, 5, 1)), ("utc", "2024-01-05 01:00:00 " + "x" * 5_000, None, None),
]


def run(spark, cases):
    rows = spark.createDataFrame([(i, f, t, c, "clash") for i, (f, t, c, _) in enumerate(cases)], ROWS)
    files = spark.createDataFrame(LISTED, FILES)
    return {r["row_id"]: r["utc_us"] for r in instants.found(rows, files).collect()}


def test_forms_and_zones(spark):
    got = run(spark, CASES)
    assert {i: got.get(i) for i in range(len(CASES))} == {i: c[3] for i, c in enumerate(CASES)}
    assert instants.found(spark.createDataFrame([], ROWS), spark.createDataFrame([], FILES)).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)), min_size=150, max_size=250))
def test_local_times_like_zoneinfo(spark, times):
    cases = []
    for t in times:
        t = t.replace(microsecond=0)
        for name, zone in (("de", ZoneInfo("Europe/Berlin")), ("ny", ZoneInfo("America/New_York"))):
            local = t.replace(tzinfo=zone, fold=0)
            real = local.astimezone(UTC).astimezone(zone).replace(tzinfo=None) == t
            cases.append((name, t.strftime("%Y-%m-%d %H:%M:%S"), None, int((local.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 if real else None))
    got = run(spark, cases)
    assert {i: got.get(i) for i in range(len(cases))} == {i: c[3] for i, c in enumerate(cases)}
