"""Aggregates and ordered scans over streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.operators.ordered import neighbour, running_sum


def pearson(x: Column, y: Column) -> Column:
    """Correlation by population moments; null below three pairs or where a side is constant."""
    spread = F.when(x.isNotNull() & y.isNotNull(), x), F.when(x.isNotNull() & y.isNotNull(), y)
    r = F.try_divide(F.covar_pop(*spread), F.stddev_pop(spread[0]) * F.stddev_pop(spread[1]))
    return F.when(F.count(spread[0]) >= 3, r)


def summary(x: Column) -> list[Column]:
    return [F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.25).alias("q25"),
            F.percentile(x, 0.75).alias("q75"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg((x == 0).cast("int")), 6).alias("zero_share")]


def channels(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a channel: channel counts from 1, p is its value."""
    return df.select("*", F.posexplode(F.array(*names)).alias("_c", "p")).withColumn("channel", F.col("_c") + 1).drop("_c")


def top_values(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of a key with their shares; of equally frequent ones the smaller comes first."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = c.withColumn("rk", F.row_number().over(w.orderBy(F.desc("n"), value))).withColumn("_total", F.sum("n").over(w))
    return ranked.where(F.col("rk") <= k).select(*keys, value, "n", "rk", F.round(F.col("n") / F.col("_total"), 6).alias("share"))


def binned_trend(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(bin, n, median_y) over the distinct quantiles of x as edges; the last bin holds its right edge."""
    edges = df.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_e")).select(F.array_sort(F.array_distinct("_e")).alias("_e"))
    placed = df.withColumn("_e", edges.scalar())  # at most bins + 1 edges
    at = F.least(F.size(F.filter("_e", lambda e: e <= F.col(x))), F.size("_e") - 1)
    return placed.where(F.col(x).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.percentile(y, 0.5).alias("median_y"))


def movements(df: DataFrame, keys: list[str], order: list[str], shard: str, time: str, channels: list[str], share: float, max_step_s: int = 5) -> DataFrame:
    """Rows whose channels change from the row before, at most max_step_s ago, by at least the `share` quantile of the
    changes of their key where any channel is loaded."""
    rows = neighbour(df, keys, order, shard, [time, *channels], "_b")
    change, load = F.lit(0), F.lit(0)
    for c in channels:
        change, load = change + F.abs(F.col(c) - F.col("_b")[c]), load + F.col(c)
    rows = rows.withColumns({"_change": F.when(F.col(time) - F.col("_b")[time] <= max_step_s, change), "_load": load}).drop("_b")
    least = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.percentile(F.when(F.col("_load") > 0, F.col("_change")), share).alias("_least"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(least, same).where(F.coalesce("_change", F.lit(0)) >= F.col("_least")).select(*df.columns)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Category of every key: csv_only, txt_only, count_mismatch, value_mismatch or included, values paired by place."""
    packed = lambda x, n: x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *values))), lambda r: F.struct(*[r[v] for v in values])).alias(n))
    both = packed(a, "_a").join(packed(b, "_b"), keys, "full_outer")
    kind = (F.when(F.col("_b").isNull(), "csv_only").when(F.col("_a").isNull(), "txt_only").when(F.size("_a") != F.size("_b"), "count_mismatch")
            .when(F.exists(F.zip_with("_a", "_b", lambda x, y: ~x.eqNullSafe(y)), lambda x: x), "value_mismatch").otherwise("included"))
    return both.select(*keys, kind.alias("category"))


def bridged_sessions(df: DataFrame, keys: list[str], order: list[str], shard: str, time: str, file: str, bridging: Column, gap_s: int = 1_800, chunk_s: int = 1_800, slack_s: int = 10) -> DataFrame:
    """Add session, gap_before_s and bridged: a gap over gap_s starts a session, unless it is one to three upload chunks
    long within slack_s, at a file boundary, on a stream where `bridging` holds."""
    rows = neighbour(df, keys, order, shard, [time, file], "_b")
    gap = F.col(time) - F.col("_b")[time]
    n = F.call_function("div", gap + chunk_s // 2, F.lit(chunk_s))
    bridge = (F.col(file) != F.col("_b")[file]) & bridging & (gap >= 1_500) & (F.abs(gap - n * chunk_s) <= slack_s) & n.between(1, 3)
    rows = rows.withColumn("gap_before_s", gap).withColumn("_new", (gap.isNull() | ((gap > gap_s) & ~F.coalesce(bridge, F.lit(False)))).cast("long"))
    rows = rows.withColumn("bridged", F.coalesce((F.col("gap_before_s") > gap_s) & (F.col("_new") == 0), F.lit(False))).drop("_b")
    return running_sum(rows, keys, order, shard, "_new", "session").drop("_new")


def ordinals(df: DataFrame) -> DataFrame:
    """Chronological number of each subject's nights."""
    nights = df.select("subject_id", "night").distinct()
    return nights.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("subject_id").orderBy("night")))


def _median(values: Column) -> Column:
    v = F.array_sort(values)
    n = F.size(v)
    return (F.element_at(v, F.call_function("div", n + 1, F.lit(2)).cast("int")) + F.element_at(v, (F.call_function("div", n, F.lit(2)) + 1).cast("int"))) / 2


def split_scores(units: DataFrame, width: int) -> DataFrame:
    """(subject_id, k, score): median of the next `width` units less that of the `width` units before k."""
    w = Window.partitionBy("subject_id").orderBy("k")
    sides = units.withColumn("_a", F.collect_list("x").over(w.rowsBetween(0, width - 1))).withColumn("_b", F.collect_list("x").over(w.rowsBetween(-width, -1)))
    whole = sides.where((F.size("_a") == width) & (F.size("_b") == width))
    return whole.select("subject_id", "k", F.round(_median(F.col("_a")) - _median(F.col("_b")), 6).alias("score"))


def distinct_peaks(scores: DataFrame, radius: int, top: int) -> DataFrame:
    """Strongest splits of each subject, none within `radius` units of a stronger one: greedy, so one small Arrow group each.

    A group has one row a night; its size is bounded by the calendar.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.assign(_s=pdf["score"].abs()).sort_values(["_s", "k"], ascending=[False, True])
        rows = []
        while len(left) and len(rows) < top:
            best = left.iloc[0]
            rows.append((best["subject_id"], int(best["k"]), float(best["score"]), len(rows) + 1))
            left = left[(left["k"] - best["k"]).abs() > radius]
        return pd.DataFrame(rows, columns=["subject_id", "k", "score", "peak"])

    return scores.groupBy("subject_id").applyInPandas(pick, "subject_id string, k int, score double, peak int")


def best_split(units: DataFrame) -> DataFrame:
    """(subject_id, best_k): first unit of the second part in the split of least squared error, by prefix sums."""
    w = Window.partitionBy("subject_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("subject_id")
    s = units.select("subject_id", "k", F.sum("x").over(w).alias("s1"), F.count("x").over(w).alias("n1"), F.sum("x").over(whole).alias("s"), F.count("x").over(whole).alias("n")).where("n1 > 0")
    gain = F.col("s1") * F.col("s1") / F.col("n1") + (F.col("s") - F.col("s1")) * (F.col("s") - F.col("s1")) / (F.col("n") - F.col("n1"))
    return s.withColumn("_g", F.round(gain, 6)).groupBy("subject_id").agg(F.max_by("k", F.struct("_g", -F.col("k"))).alias("best_k"))
