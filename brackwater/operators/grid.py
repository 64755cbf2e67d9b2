"""Irregular readings onto a regular grid.

Readings are first reduced map-side to one row an occupied bin.  Each series is cut into time shards; a shard knows its
first and last occupied bin, the boundary state (first reading after the shard) is carried by a scan over the shard
summaries, and then every shard fills its own bins independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.shared import DAY_S, epoch_us, floor_div

CHANNELS = ["p1", "p2", "p3", "p4", "p5", "p6", "temp", "humid"]
REACH_S = 1_800


def _value(c: str):
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


def occupied_bins(rows: DataFrame, specs: DataFrame, values: bool) -> DataFrame:
    """One row an occupied bin: its first and last reading and, on demand, the channel means."""
    spec = specs.where((F.col("bin_s") > 0) & F.col("spec_code").isNotNull()).groupBy("spec_code").agg(
        F.min(F.struct("bin_s", "max_gap_s")).alias("_spec")).select(F.col("spec_code").alias("_code"), "_spec.bin_s", "_spec.max_gap_s")
    kept = rows.select(F.col("subject_id"), F.col("device_id"), F.col("spec_code").alias("_code"), epoch_us(F.col("ts")).alias("_us"),
                       *[_value(c).alias(c) for c in CHANNELS]).where(F.col("_us").isNotNull() & F.coalesce(*[F.col(c).cast("double") for c in CHANNELS]).isNotNull())
    means = [F.avg(c).alias(c) for c in CHANNELS] if values else []
    return (kept.join(spec, "_code").withColumn("k", floor_div(F.col("_us"), F.col("bin_s").cast("long") * 1_000_000))
            .groupBy("subject_id", "device_id", "bin_s", "max_gap_s", "k")
            .agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count("*").alias("n_readings"), *means))


def with_next(bins: DataFrame, shard_s: int = DAY_S) -> DataFrame:
    """Add next_k and next_us, the next occupied bin of the series and its first reading, across shard boundaries."""
    keys = ["subject_id", "device_id", "bin_s", "max_gap_s"]
    shards = bins.withColumn("_c", floor_div(F.col("k") * F.col("bin_s"), shard_s))
    inside = Window.partitionBy(*keys, "_c").orderBy("k")
    here = shards.withColumn("_next", F.lead(F.struct("k", "first_us")).over(inside))
    heads = shards.groupBy(*keys, "_c").agg(F.min(F.struct("k", "first_us")).alias("_head"))
    along = Window.partitionBy(*keys).orderBy("_c")
    carry = heads.select(*keys, "_c", F.lead("_head").over(along).alias("_carry")).where(F.col("_carry").isNotNull())
    carry = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_c"])], "_carry")
    cond = F.col("_next").isNull()
    for i, k in enumerate([*keys, "_c"]):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ends = here.where(F.col("_next").isNull()).join(carry, cond, "left").withColumn("_next", F.col("_carry")).select(*here.columns)
    return (here.where(F.col("_next").isNotNull()).unionByName(ends)
            .withColumn("next_k", F.col("_next.k")).withColumn("next_us", F.col("_next.first_us")).drop("_next", "_c"))


def gap_state():
    """filled or missing for the empty bins after an occupied one; null where there is no gap to judge."""
    gap = (F.col("next_k") - F.col("k") > 1) & (F.col("next_us") - F.col("last_us") <= REACH_S * 1_000_000)
    return F.when(gap, F.when((F.col("next_k") - F.col("k") - 1) * F.col("bin_s") <= F.col("max_gap_s"), "filled").otherwise("missing"))


def found(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Runs of empty bins between two readings at most 1,800 s apart.

    Defined cases: rows without time, without any of the eight values (NaN counts as none) or without a known spec are no
    readings; repeated rows fall into their bin; a null series key is a value of its own; a null max_gap_s gives missing.
    """
    after = with_next(occupied_bins(rows, specs, values=False)).withColumn("state", gap_state()).where(F.col("state").isNotNull())
    return after.select("subject_id", "device_id", ((F.col("k") + 1) * F.col("bin_s")).alias("from_s"), (F.col("next_k") * F.col("bin_s")).alias("to_s"), "state")


def regular(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """The whole grid: (subject_id, device_id, bin_start_s, state, channel means).

    state is observed, filled (the last means carried forward, at most max_gap_s) or missing (nulls); stretches of more
    than 1,800 s without readings are outside the grid.
    """
    after = with_next(occupied_bins(rows, specs, values=True)).withColumn("_gap", gap_state())
    last = F.when(F.col("_gap").isNotNull(), F.col("next_k") - 1).otherwise(F.col("k"))
    grid = after.withColumn("_k", F.explode(F.sequence(F.col("k"), last)))
    state = F.when(F.col("_k") == F.col("k"), "observed").otherwise(F.col("_gap"))
    return grid.select("subject_id", "device_id", (F.col("_k") * F.col("bin_s")).alias("bin_start_s"), state.alias("state"),
                       *[F.when(state != "missing", F.col(c)).alias(c) for c in CHANNELS])
