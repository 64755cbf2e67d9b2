"""The re-timed sensor stream that the queries of the row operators share, in the same arithmetic for both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.shared import table

_ROW = """
  event_id as row_id,
  concat('U0', cast((event_id {D} 100) % 3 + 1 as {T})) as subject_id,
  case when (event_id {D} 100) % 3 = 1 then concat('d', cast(event_id % 2 as {T})) else 'unknown' end as device_id,
  1704067200 + ((event_id {D} 100) {D} 3) * 86400 + 79200 + (event_id % 100) * 2 + 7 * ((event_id % 100) {D} 40)
    - case when event_id % 97 = 0 and event_id % 100 > 1 then 2 else 0 end as ts_s,
  case when event_id % 11 = 0 then 0 else (event_id * 7919 + 13) % 4096 end as p1,
  case when event_id % 11 = 0 then 0 else (event_id * 6101 + 29) % 4096 end as p2,
  case when event_id % 11 = 0 then 0 when event_id % 23 = 0 then 4095 else (event_id * 3571) % 4096 end as p3,
  case when event_id % 11 = 0 or event_id % 3 = 0 then 0 else (event_id * 2801) % 4096 end as p4,
  case when event_id % 11 = 0 or event_id % 5 = 0 then 0 else (event_id * 1907) % 4096 end as p5,
  case when event_id % 11 = 0 or event_id % 7 = 0 then 0 else (event_id * 1009) % 4096 end as p6,
  case when event_id % 53 = 0 then 0 when event_id % 211 = 0 then 256 else 20 + (event_id * 13) % 17 end as temperature,
  case when event_id % 53 = 0 then 0 when event_id % 307 = 0 then 152 else 30 + (event_id * 29) % 50 end as humidity,
  case when event_id % 40 = 7 then 'AHON' when event_id % 40 = 29 then 'AHOF UM' else 'LM' end as event_raw"""
_FIELDS = [x.strip() for x in _ROW.replace("{D}", "div").replace("{T}", "string").strip().split(",\n")]

P = ["p1", "p2", "p3", "p4", "p5", "p6"]


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a reading, with its night (noon to noon), the shard of ordered scans (day) and the file it came in."""
    rows = table(spark, sf_dir, "events").selectExpr(*_FIELDS)
    return rows.withColumns({"night": F.expr("(ts_s - 43200) div 86400"), "day": F.expr("ts_s div 86400"), "file_no": F.expr("row_id div 250")})


SENSOR = "s as (select *, (ts_s - 43200) // 86400 as night, ts_s // 86400 as day, row_id // 250 as file_no from (select " + _ROW.replace("{D}", "//").replace("{T}", "varchar") + " from events) e)"
STREAM = "subject_id, device_id"
# Session (gap over 1,800 s) and segment (gap over 5 s) of every row.
PLACED = f"""{SENSOR},
lagged as (select *, lag(ts_s) over (partition by {STREAM} order by ts_s, row_id) as before from s),
placed as (
  select *, sum(case when before is null or ts_s - before > 1800 then 1 else 0 end) over w as session,
    sum(case when before is null or ts_s - before > 5 then 1 else 0 end) over w as segment
  from lagged window w as (partition by {STREAM} order by ts_s, row_id rows unbounded preceding))"""
# Predictions by integer expressions: three seeds of a model and the truth, per row with valid targets.
PREDICTED = f"""{PLACED},
pred as (
  select placed.*, seed, target, case target when 'temperature' then temperature else humidity end as y,
    case target when 'temperature' then 24 + (row_id * 7) % 9 + seed else 50 + (row_id * 11) % 13 - seed end as p
  from placed, (values (0), (1), (2)) as q(seed), (values ('temperature'), ('humidity')) as v(target)
  where temperature between 1 and 59 and humidity between 1 and 100)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brackwater.operators.ordered import neighbour, running_sum

    rows = neighbour(sensor(spark, sf_dir), ["subject_id", "device_id"], ["ts_s", "row_id"], "day", ["ts_s"], "_b").withColumn("before", F.col("_b.ts_s")).drop("_b")
    gap = F.col("ts_s") - F.col("before")
    rows = rows.withColumns({"_s": (gap.isNull() | (gap > 1_800)).cast("long"), "_g": (gap.isNull() | (gap > 5)).cast("long")})
    for flag, out in (("_s", "session"), ("_g", "segment")):
        rows = running_sum(rows, ["subject_id", "device_id"], ["ts_s", "row_id"], "day", flag, out)
    return rows.drop("_s", "_g")


def targets_valid() -> Column:
    return F.col("temperature").between(1, 59) & F.col("humidity").between(1, 100)


def prediction(target: str, seed: Column | int) -> Column:
    return 24 + (F.col("row_id") * 7) % 9 + seed if target == "temperature" else 50 + (F.col("row_id") * 11) % 13 - seed


def predicted(rows: DataFrame) -> DataFrame:
    valid = rows.where(targets_valid())
    cases = valid.withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("target", F.explode(F.array(F.lit("temperature"), F.lit("humidity"))))
    warm = F.col("target") == "temperature"
    return cases.withColumns({"y": F.when(warm, F.col("temperature")).otherwise(F.col("humidity")),
                              "p": F.when(warm, prediction("temperature", F.col("seed"))).otherwise(prediction("humidity", F.col("seed")))})
