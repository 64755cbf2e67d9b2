"""Grouping activity into sessions separated by inactivity gaps.

Time is cut into chunks.  Inside a chunk the distinct starts of a user become local partial sessions; a partial that is
neither the first nor the last of its chunk is final.  The first and last partials (at most two a chunk, so bounded by
the calendar and not by the rows) are merged along the user wherever the gap at the boundary is within the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.shared import DAY_S, epoch_s, floor_div

GAP_S = 1_800
PROV_START = r"\|\s*(\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2})\s*$"


def window_start(t0: Column, prov: Column) -> Column:
    """t0, else the third part of prov (device|night|start); null where neither gives a time."""
    text = F.regexp_extract(prov, PROV_START, 1)
    return F.coalesce(t0.cast("long"), epoch_s(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd H:mm:ss")).cast("timestamp_ntz")))


def sessions(df: DataFrame, keys: list[str], start: str, gap_s: int = GAP_S, chunk_s: int = DAY_S) -> DataFrame:
    """(keys, start_s, end_s, duration_s, n_events): sessions of the distinct values of `start` (epoch seconds).

    Defined cases: rows without start do not count; repeated starts count once; a null key part is a value of its own;
    a gap of exactly gap_s stays inside a session; an empty input gives no rows; other columns are ignored, so clashing
    names cannot matter.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    starts = (df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(start).cast("long").alias("_s"))
              .where(F.col("_s").isNotNull()).distinct().withColumn("_c", floor_div(F.col("_s"), chunk_s)))
    chunk = Window.partitionBy(*names, "_c").orderBy("_s")
    local = (starts.withColumn("_new", (F.coalesce(F.col("_s") - F.lag("_s").over(chunk), F.lit(gap_s + 1)) > gap_s).cast("long"))
             .withColumn("_no", F.sum("_new").over(chunk.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*names, "_c", "_no").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"), F.count("*").alias("_n")))
    part = local.withColumn("_last", F.max("_no").over(Window.partitionBy(*names, "_c")))
    edge = (F.col("_no") == 1) | (F.col("_no") == F.col("_last"))
    along = Window.partitionBy(*names).orderBy("_a")
    merged = (part.where(edge)
              .withColumn("_new", (F.coalesce(F.col("_a") - F.lag("_b").over(along), F.lit(gap_s + 1)) > gap_s).cast("long"))
              .withColumn("_no", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*names, "_no").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_n").alias("_n")))
    whole = part.where(~edge).select(*names, "_a", "_b", "_n").unionByName(merged.select(*names, "_a", "_b", "_n"))
    return whole.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("_a").alias("start_s"), F.col("_b").alias("end_s"),
                        (F.col("_b") - F.col("_a")).alias("duration_s"), F.col("_n").alias("n_events"))


def found(windows: DataFrame) -> DataFrame:
    rows = windows.select("subject_id", "device_id", window_start(F.col("t0"), F.col("prov")).alias("start"))
    return sessions(rows, ["subject_id", "device_id"], "start").select("subject_id", "device_id", "start_s", "end_s", F.col("n_events").alias("n_windows"))
