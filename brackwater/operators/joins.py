"""As-of, nearest and interval joins as scans of one ordered union, sharded by time so that no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.shared import sharded_previous

SHARD_S = 86_400


def _union(targets: DataFrame, events: DataFrame, keys: list[str], time: str, values: list[str], tie: str | None, side: int = 0) -> DataFrame:
    t = targets.withColumns({"_t": F.col(time), "_side": F.lit(1), "_tie": F.lit(None).cast("long"), "_ev": F.lit(None)})
    struct = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values])
    e = events.select(*keys, F.col(time).alias("_t"), F.lit(side).alias("_side"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"), struct.alias("_ev"))
    t = t.withColumn("_ev", F.lit(None).cast(e.schema["_ev"].dataType))
    both = t.unionByName(e, allowMissingColumns=True)
    return both.withColumn("_shard", F.expr(f"_t div {SHARD_S}"))


def asof(targets: DataFrame, events: DataFrame, keys: list[str], time: str, values: list[str], within_s: int, tie: str | None = None) -> DataFrame:
    """Add struct `event` (t and values): the last event of the key at or before each target, at most within_s old; else null.

    An event of the same second is past; equal times go by `tie`, the greatest counts.
    """
    both = sharded_previous(_union(targets, events, keys, time, values, tie), keys, ["_t", "_side", "_tie"], "_shard", "_ev", "_last")
    fresh = F.when(F.col("_t") - F.col("_last.t") <= within_s, F.col("_last"))
    return both.where("_side = 1").select(*targets.columns, fresh.alias("event"))


def nearest(targets: DataFrame, others: DataFrame, keys: list[str], time: str, values: list[str], within_s: int, tie: str | None = None) -> DataFrame:
    """Add struct `near` (t and values): the other row of the key nearest in time, at most within_s away; else null.

    Of two equally near rows the earlier counts; a row may serve several targets.
    """
    both = _union(targets, others, keys, time, values, tie)
    both = sharded_previous(both, keys, ["_t", "_side", "_tie"], "_shard", "_ev", "_before")
    both = sharded_previous(both, keys, ["_t", "_side", "_tie"], "_shard", "_ev", "_after", ahead=True)
    back, ahead = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    pick = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_before")).otherwise(F.col("_after"))
    rows = both.where("_side = 1").select(*targets.columns, pick.alias("_near"))
    return rows.select(*targets.columns, F.when(F.abs(F.col(time) - F.col("_near.t")) <= within_s, F.col("_near")).alias("near"))


def adjacent(targets: DataFrame, others: DataFrame, keys: list[str], time: str, values: list[str], tie: str) -> DataFrame:
    """Add structs `before` (the last other row of the key before each target) and `after` (the first at or after it)."""
    both = _union(targets, others, keys, time, values, tie, side=2)
    both = sharded_previous(both, keys, ["_t", "_side", "_tie"], "_shard", "_ev", "before")
    both = sharded_previous(both, keys, ["_t", "_side", "_tie"], "_shard", "_ev", "after", ahead=True)
    return both.where("_side = 1").select(*targets.columns, "before", "after")


def coincidence(times: DataFrame, events: DataFrame, coverage: DataFrame, keys: list[str], time: str, within_s: int) -> DataFrame:
    """The times that lie in the coverage [lo, hi) of their key, with `hit`: an event of the key is at most within_s away."""
    inside = in_range(times, coverage.select(*keys, "lo", (F.col("hi") - 1).alias("_end")), keys, time, "lo", "_end").select(*times.columns)
    return nearest(inside, events, keys, time, [], within_s).withColumn("hit", F.col("near").isNotNull().cast("int")).drop("near")


def covered(df: DataFrame, keys: list[str], order: list[str], time: str, shard: str, cap_s: int, last_s: int | None = None) -> DataFrame:
    """(keys, lo, hi): intervals covered by rows, a row covering up to the next one but at most cap_s seconds.

    The last row of a key covers last_s seconds, cap_s if not given.
    """
    from brackwater.operators.ordered import islands, neighbour

    rows = neighbour(df.select(*dict.fromkeys([*keys, *order, time, shard])), keys, order, shard, [time], "_next", ahead=True)
    rows = rows.withColumn("_hi", F.col(time) + F.least(F.coalesce(F.col("_next")[time] - F.col(time), F.lit(cap_s if last_s is None else last_s)), F.lit(cap_s))).drop("_next")
    placed = islands(rows, keys, order, shard, ["_hi"], lambda prev: F.col(time) > prev("_hi"), "_i")
    return placed.groupBy(*keys, "_i").agg(F.min(time).alias("lo"), F.max("_hi").alias("hi")).drop("_i")


def merged_length(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, seconds): length of the union of intervals; time is cut into days, so that no key is scanned in one piece."""
    from pyspark.sql.window import Window

    day = F.explode(F.sequence(F.expr(f"{lo} div {SHARD_S}"), F.expr(f"({hi} - 1) div {SHARD_S}")))
    cut = df.where(F.col(hi) > F.col(lo)).withColumn("_d", day)
    cut = cut.select(*keys, "_d", F.greatest(F.col(lo), F.col("_d") * SHARD_S).alias("_a"), F.least(F.col(hi), (F.col("_d") + 1) * SHARD_S).alias("_b")).distinct()
    w = Window.partitionBy(*keys, "_d").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    own = F.greatest(F.col("_b") - F.greatest(F.col("_a"), F.coalesce(F.max("_b").over(w), F.col("_a"))), F.lit(0))
    return cut.withColumn("_own", own).groupBy(*keys).agg(F.sum("_own").alias("seconds"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seconds): time that the intervals (lo, hi) of both sides share; each side's own intervals must be disjoint."""
    day = lambda: F.explode(F.sequence(F.expr(f"lo div {SHARD_S}"), F.expr(f"(hi - 1) div {SHARD_S}")))
    cut = lambda x, n: x.where("hi > lo").withColumn("_d", day()).select(*keys, "_d", F.greatest(F.col("lo"), F.col("_d") * SHARD_S).alias(f"lo{n}"), F.least(F.col("hi"), (F.col("_d") + 1) * SHARD_S).alias(f"hi{n}"))
    met = cut(a, 1).join(cut(b, 2), [*keys, "_d"]).where("lo1 < hi2 and lo2 < hi1")
    return met.groupBy(*keys).agg(F.sum(F.least("hi1", "hi2") - F.greatest("lo1", "lo2")).alias("seconds"))


def in_range(rows: DataFrame, ranges: DataFrame, keys: list[str], time: str, lo: str, hi: str, bucket_s: int = SHARD_S) -> DataFrame:
    """Rows joined to the ranges [lo, hi] that hold them, as an equi-join on time buckets."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.expr(f"{lo} div {bucket_s}"), F.expr(f"{hi} div {bucket_s}"))))
    return rows.withColumn("_b", F.expr(f"{time} div {bucket_s}")).join(cut, [*keys, "_b"]).where(F.col(time).between(F.col(lo), F.col(hi))).drop("_b")


def conflict(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
