"""Fixed time-bin windows of gap-free segments, and their array features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.functions.quality import dominant


def windows(rows: DataFrame, keys: list[str], time: str, tie: str, values: list[str], bin_s: int = 5, bins: int = 8, stride_s: int = 20) -> DataFrame:
    """(keys, k, t0, target_ts, target_row, steps): windows of `bins` bins, every `stride_s` seconds from a segment's start.

    `keys` names the segment.  A window's step is the last row of its bin; a window exists while its last bin begins
    within the segment.  Each row computes the windows that hold it, so there is no range join.
    """
    size = bin_s * bins
    ends = rows.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    placed = rows.join(ends, keys).withColumn("_rel", F.col(time) - F.col("_a"))
    top = F.expr(f"(_b - {size - bin_s} - _a) div {stride_s}")
    first = F.greatest(F.expr(f"(_rel - {size} + {stride_s}) div {stride_s}"), F.lit(0).cast("long"))
    last = F.least(F.expr(f"_rel div {stride_s}"), top)
    hit = placed.where((F.col("_b") - F.col("_a") >= size - bin_s) & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))
    hit = hit.withColumn("t0", F.col("_a") + F.col("k") * stride_s).where(F.col(time) < F.col("t0") + size).withColumn("_bin", F.expr(f"({time} - t0) div {bin_s}"))
    step = F.struct(F.col(time).alias("ts"), F.col(tie).alias("row"), F.array(*[F.col(v).cast("int") for v in values]).alias("p"))
    steps = hit.groupBy(*keys, "k", "t0", "_bin").agg(F.max_by(step, F.struct(time, tie)).alias("_s"))
    out = steps.groupBy(*keys, "k", "t0").agg(F.array_sort(F.collect_list(F.struct("_bin", "_s"))).alias("_l")).where(F.size("_l") == bins)
    out = out.withColumn("steps", F.transform("_l", lambda x: x["_s"]))
    end = F.element_at("steps", -1)
    return out.select(*keys, "k", "t0", end["ts"].alias("target_ts"), end["row"].alias("target_row"), "steps")


def frames(steps: Column) -> Column:
    return F.transform(steps, lambda s: s["p"])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def raw(frames_: Column, top: float = 4_095.0) -> Column:
    return F.transform(frames_, lambda f: F.transform(f, lambda p: p / top))


def contact(f: Column, top: float = 4_095.0) -> Column:
    """sum, active, six shares, normalised entropy, greatest share, spread of one frame; zeros for an empty frame."""
    total = _sum(f)
    shares = F.transform(f, lambda p: F.coalesce(F.try_divide(p, total), F.lit(0.0)))
    entropy = -_sum(F.transform(shares, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) / F.ln(F.lit(6.0))
    mean = total / F.size(f)
    sd = F.sqrt(_sum(F.transform(f, lambda p: (p - mean) * (p - mean))) / F.size(f)) / top
    active = F.size(F.filter(f, lambda p: p > 0)).cast("double")
    return F.concat(F.array(total, active), shares, F.array(F.abs(entropy), F.array_max(shares), sd))


def movement(frames_: Column) -> Column:
    """Per step: six differences to the step before, mean absolute difference, change of sum and of active channels, switch."""

    def one(i: Column) -> Column:
        now, old = F.element_at(frames_, i), F.element_at(frames_, i - 1)
        diff = F.zip_with(now, old, lambda a, b: (a - b).cast("double"))
        size = _sum(F.transform(diff, lambda x: F.abs(x))) / 6
        act = lambda f: F.size(F.filter(f, lambda p: p > 0)).cast("double")
        return F.concat(diff, F.array(size, _sum(diff), act(now) - act(old), (dominant(now) != dominant(old)).cast("double")))

    zero = F.array_repeat(F.lit(0.0), 10)
    return F.concat(F.array(zero), F.transform(F.sequence(F.lit(2), F.size(frames_)), one))


def history(rows: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Per window and channel: mean, spread, least, greatest, last, net change and total variation of its steps."""
    flat = rows.select(*keys, F.posexplode("steps").alias("i", "s"))
    long = flat.select(*keys, "i", F.posexplode("s.p").alias("channel", "x"))
    ordered = long.groupBy(*keys, "channel").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), F.max_by("x", "i").alias("last"),
        (F.max_by("x", "i") - F.min_by("x", "i")).alias("net"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_x"))
    steps = F.zip_with(F.slice("_x", 2, F.size("_x") - 1), F.slice("_x", 1, F.size("_x") - 1), lambda a, b: F.abs(a - b))
    return ordered.withColumn("variation", F.aggregate(steps, F.lit(0), lambda a, b: a + b)).drop("_x")
