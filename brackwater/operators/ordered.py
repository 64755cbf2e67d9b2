"""Ordered scans along a key that never put a whole key into one task: previous row, running sum, islands.

Rows are scanned inside (key, shard); only one summary row a shard is scanned along the key.  `shard` is a column that
does not decrease with the order inside a key, such as the day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.shared import written


def _match(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & a[k].eqNullSafe(b[f"_k{i}"])
    return cond


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def neighbour(df: DataFrame, keys: list[str], order: list[str], shard: str, values: list[str], out: str, ahead: bool = False) -> DataFrame:
    """Add the struct `out` of `values` of the row before (or after) in the order of the key; null at its end."""
    at = [*keys, shard]
    step = F.lead if ahead else F.lag
    inside = Window.partitionBy(*at).orderBy(*order)
    pack = F.struct(*[F.col(v).alias(v) for v in values])
    edge = (F.min_by if ahead else F.max_by)(pack, F.struct(*order)).alias("_edge")
    along = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(f"_k{len(keys)}")
    edges = df.groupBy(*at).agg(edge).select(*_renamed(at), "_edge").withColumn("_carry", step("_edge").over(along)).drop("_edge")
    local = df.withColumn("_near", step(pack).over(inside))
    joined = local.join(edges, _match(local, edges, at), "left")
    return joined.select(*[local[c] for c in df.columns], F.coalesce("_near", "_carry").alias(out))


def running_sum(df: DataFrame, keys: list[str], order: list[str], shard: str, value: str, out: str) -> DataFrame:
    """Add `out`, the sum of `value` up to and including the row, in the order of the key."""
    at = [*keys, shard]
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(f"_k{len(keys)}").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*at).agg(F.sum(value).alias("_total")).select(*_renamed(at), "_total")
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(along), F.lit(0))).drop("_total")
    local = df.withColumn("_sum", F.sum(value).over(inside))
    joined = local.join(totals, _match(local, totals, at))
    return joined.select(*[local[c] for c in df.columns], (F.col("_sum") + F.col("_before")).alias(out))


def islands(df: DataFrame, keys: list[str], order: list[str], shard: str, values: list[str], starts: Callable[[Callable[[str], Column]], Column], out: str) -> DataFrame:
    """Number the islands of each key from 1: `starts(prev)` says, from the row and the row before, where one begins.

    The first row of a key always begins one.
    """
    before = neighbour(df, keys, order, shard, values, "_prev")
    begin = F.col("_prev").isNull() | F.coalesce(starts(lambda name: F.col("_prev")[name]), F.lit(False))
    flagged = before.withColumn("_begin", begin.cast("long")).drop("_prev")
    return running_sum(flagged, keys, order, shard, "_begin", out).drop("_begin")


def longest_true(df: DataFrame, keys: list[str], order: list[str], shard: str, flag: str) -> DataFrame:
    """(keys, longest): rows in the longest run of true flags of each key, 0 if there is none."""
    runs = islands(df.withColumn("_f", F.coalesce(F.col(flag), F.lit(False))), keys, order, shard, ["_f"], lambda p: p("_f") != F.col("_f"), "_run")
    sizes = runs.groupBy(*keys, "_run").agg(F.sum(F.col("_f").cast("long")).alias("_n"))
    return sizes.groupBy(*keys).agg(F.max("_n").alias("longest"))


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add `out`, the place of each row in a total order, from 0: places inside range partitions plus the sizes of those before.

    The sorted rows are written once, as both the sizes and the places must come from the same partitions.
    """
    ordered = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_id", 33))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a partition
    before = F.coalesce(F.sum("_size").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    return ordered.join(sizes, F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(out))
