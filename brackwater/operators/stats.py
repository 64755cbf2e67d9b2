"""Distances of distributions, rank statistics, error metrics, fits and cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brackwater.operators.series import pearson


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the average rank of `value` in its key: ranks come from counts of distinct values, never from sorting all rows."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = c.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), (F.coalesce(below, F.lit(0)) + (F.col("_n") + 1) / 2).alias(out))
    cond = F.col(value) == F.col("_v")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, cond, "left").select(*df.columns, out)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    both = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(pearson(F.col("_rx"), F.col("_ry")), 6).alias("rho"))


def distribution_shift(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """(keys, n_a, n_b, w1, ks) of the values where side holds (b) and where not (a): exact distances from value counts."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(~side).alias("_a"), F.count_if(side).alias("_b"))
    total = Window.partitionBy(*keys)
    upto = total.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    f = (F.sum("_a").over(upto) / F.nullif(F.sum("_a").over(total), F.lit(0))) - (F.sum("_b").over(upto) / F.nullif(F.sum("_b").over(total), F.lit(0)))
    c = c.withColumn("_d", F.abs(f)).withColumn("_w", F.lead(value).over(total.orderBy(value)) - F.col(value))
    return c.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.round(F.sum(F.col("_d") * F.col("_w")), 6).alias("w1"), F.round(F.max("_d"), 6).alias("ks"))


def cliffs_delta(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """(keys, delta): P(b > a) - P(b < a), from average ranks."""
    ranked = average_ranks(df.withColumn("_side", side), keys, value, "_r").where(F.col("_r").isNotNull())
    g = ranked.groupBy(*keys).agg(F.count_if("_side").alias("nb"), F.count_if(~F.col("_side")).alias("na"), F.sum(F.when(F.col("_side"), F.col("_r"))).alias("rb"))
    delta = F.try_divide(2 * (F.col("rb") - F.col("nb") * (F.col("nb") + 1) / 2), F.col("na") * F.col("nb")) - 1
    return g.select(*keys, F.round(delta, 6).alias("delta"))


def robust_difference(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """Difference of medians over the pooled robust spread (IQR / 1.349)."""
    q = lambda c, p: F.percentile(F.when(c, F.col(value)), p)
    g = df.groupBy(*keys).agg(q(~side, 0.5).alias("ma"), q(side, 0.5).alias("mb"), (q(~side, 0.75) - q(~side, 0.25)).alias("ia"), (q(side, 0.75) - q(side, 0.25)).alias("ib"))
    spread = F.sqrt((F.pow(F.col("ia") / 1.349, 2) + F.pow(F.col("ib") / 1.349, 2)) / 2)
    return g.select(*keys, "ma", "mb", F.round(F.try_divide(F.col("mb") - F.col("ma"), spread), 6).alias("robust_sd"))


def eta_squared(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Share of the variation that lies between groups; null below two groups or without variation."""
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).where("n > 0")
    t = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return t.select(*keys, F.when((F.col("k") >= 2) & (F.col("q") > centre), F.round((F.col("b") - centre) / (F.col("q") - centre), 6)).alias("eta2"))


def errors(y: Column, p: Column) -> list[Column]:
    e = (p - y).cast("double")
    return [F.count(e).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias")]


def signal(y: Column, p: Column) -> list[Column]:
    """Spread of the error and of the prediction against the truth's, and their correlation."""
    sd = F.stddev_pop(y)
    return [F.round(F.try_divide(F.stddev_pop(p - y), sd), 6).alias("r_error"), F.round(F.try_divide(F.stddev_pop(p), sd), 6).alias("q"), F.round(pearson(p, y), 6).alias("r")]


def least_squares(y: Column, x: Column) -> list[Column]:
    """Slope and intercept of y on x; a constant x gives slope 0."""
    slope = F.coalesce(F.try_divide(F.covar_pop(x.cast("double"), y.cast("double")), F.var_pop(x)), F.lit(0.0))
    return [F.round(slope, 6).alias("slope"), F.round(F.avg(y) - slope * F.avg(x), 6).alias("intercept")]


def ridge(df: DataFrame, keys: list[str], features: list[str], target: str, alpha: float) -> DataFrame:
    """(keys, weights): ridge on standardised features and target, from the normal equations.

    The moments are one aggregate (a fixed number of sums, combined map-side); only the small system is solved in Arrow.
    """
    import numpy as np
    import pandas as pd

    cols = [*features, target]
    sums = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
            *[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]]
    moments = df.groupBy(*keys).agg(*sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k, n = len(cols), row["n"]
                mean = np.array([row[f"s{i}"] for i in range(k)]) / n
                cov = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
                z = cov / np.outer(sd, sd) * n
                w = np.linalg.solve(z[:-1, :-1] + alpha * np.eye(k - 1), z[:-1, -1])
                out.append([*[row[c] for c in keys], [round(float(x), 9) for x in w]])
            yield pd.DataFrame(out, columns=[*keys, "weights"])

    schema = df.select(*keys).schema.add("weights", T.ArrayType(T.DoubleType()))
    return moments.mapInPandas(solve, schema)


DRAWS_A_GROUP = 1 << 25
PERIOD = 8191


def _drawn(r, j, n):
    """The night, from 0, that draw j of resample r takes out of n; `_times` counts the same draws."""
    return (r * 7919 + j * 104729 + (r * j) % PERIOD * 31) % n


def _times(r: int, steady, n: int):
    """How often resample r draws each of n nights; `steady` is the part of every draw that is the same in all resamples, modulo n.

    The rest repeats after PERIOD draws, so a division is needed only for these; both parts and their sum stay below 2 * n.
    """
    import numpy as np

    rest = _drawn(r, np.arange(min(n, PERIOD)), n) - steady[:PERIOD]
    rest[rest < 0] += n
    return np.bincount(steady + np.resize(rest, n), minlength=2 * n).reshape(2, n).sum(axis=0)


def draws(nights: DataFrame, resamples: int) -> DataFrame:
    """(resample, ordinal, times): how often each of n nights is drawn in a resample, by an integer hash draw.

    n * resamples rows, n being a number of nights; draws come from their own ordinals, so the table is made by explode.
    """
    j = nights.select("subject_id", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pick = _drawn(F.col("r"), F.col("j"), F.col("n"))
    return j.select("subject_id", F.col("r").alias("resample"), (pick + 1).cast("long").alias("ordinal")).groupBy("subject_id", "resample", "ordinal").agg(F.count("*").alias("times"))


def resampled_sums(cells: DataFrame, key: str, values: list[str], resamples: int, draws_a_group: int = DRAWS_A_GROUP) -> DataFrame:
    """(subject_id, key, resample, values): sums of whole numbers over the nights that `draws` gives every resample.

    `cells` has subject_id, its number of `nights`, ordinal, key and values, one row a night and key.  The first value
    counts rows; a key without rows in a resample is left out.  The table of draws, nights * resamples rows, is never
    formed: a subject's resamples are cut into runs of about `draws_a_group` draws, and each run counts its own draws in
    one Arrow group, which has one row a night and key and so is bounded by the calendar.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    step = F.greatest(F.lit(1), F.least(F.lit(resamples), F.call_function("div", F.lit(draws_a_group), F.col("nights")))).cast("int")
    runs = cells.select("subject_id", key, *[F.col(c).cast("long").alias(c) for c in ("nights", "ordinal", *values)], step.alias("_step"))
    runs = runs.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.col("_step"))))
    schema = cells.select("subject_id", key).schema.add("resample", T.IntegerType())
    for v in values:
        schema = schema.add(v, T.LongType())

    def count(run):
        run = run.combine_chunks()
        kinds = pc.dictionary_encode(run[key], null_encoding="encode").combine_chunks()
        n, first, k = run["nights"][0].as_py(), run["_first"][0].as_py(), len(kinds.dictionary)
        last = min(first + run["_step"][0].as_py(), resamples)
        night = np.zeros((k, len(values), n), np.int64)
        night[kinds.indices.to_numpy(), :, run["ordinal"].to_numpy() - 1] = np.stack([run[v].to_numpy() for v in values], axis=1)
        night, steady = night.reshape(-1, n), np.arange(n) * 104729 % n
        sums = [night @ _times(r, steady, n) for r in range(first, last)]
        sums = np.array(sums).reshape(-1, len(values))
        kind, resample = np.tile(np.arange(k), last - first), np.repeat(np.arange(first, last, dtype=np.int32), k)
        kept = sums[:, 0] > 0
        columns = {"subject_id": pa.repeat(run["subject_id"][0], int(kept.sum())), key: kinds.dictionary.take(pa.array(kind[kept])), "resample": resample[kept]}
        return pa.table(columns | {v: sums[kept, i] for i, v in enumerate(values)})

    # The rows of a run are few against its draws, so runs must not be put together by their bytes.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "subject_id", "_first").groupBy("subject_id", "_first").applyInArrow(count, schema)


def side(low: Column, high: Column) -> Column:
    return F.when(low > 0, "above_zero").when(high < 0, "below_zero").otherwise("includes_zero")
