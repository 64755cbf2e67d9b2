"""Row identity, copies and set operations over files and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.operators.ordered import neighbour


def sequence_matches(df: DataFrame, parts: list[str], order: str, values: list[str], k: int) -> DataFrame:
    """(gram, n_places, n_files, first_pos): fingerprints of k consecutive rows of a part that occur more than once; the first of `parts` is the file."""
    w = Window.partitionBy(*parts).orderBy(order)
    rows = [F.concat_ws("|", *[(F.lead(v, i).over(w) if i else F.col(v)).cast("string") for v in values]) for i in range(k)]
    marked = df.select(F.md5(F.concat_ws("/", *rows)).alias("gram"), F.col(order).alias("_pos"), F.col(parts[0]).alias("_file"), F.lead(F.lit(1), k - 1).over(w).alias("_whole"))
    return marked.where("_whole is not null").groupBy("gram").agg(F.count("*").alias("n_places"), F.count_distinct("_file").alias("n_files"), F.min("_pos").alias("first_pos")).where("n_places > 1")


def duplicate_counts(df: DataFrame, stream: list[str], time: str, values: list[str], event: str) -> DataFrame:
    """Raw rows, distinct rows with and without event, distinct times, times with more than one set of values."""
    full = df.groupBy(*stream, time, *values, event).agg(F.count("*").alias("_rows"))
    value = full.groupBy(*stream, time, *values).agg(F.sum("_rows").alias("_rows"), F.count("*").alias("_full"))
    moment = value.groupBy(*stream, time).agg(F.sum("_rows").alias("_rows"), F.sum("_full").alias("_full"), F.count("*").alias("_values"))
    return moment.groupBy(*stream).agg(F.sum("_rows").alias("raw_rows"), F.sum("_full").alias("unique_full"), F.sum("_values").alias("unique_values"),
                                       F.count("*").alias("unique_times"), F.count_if(F.col("_values") > 1).alias("conflicting_times"))


def file_ranges(df: DataFrame, file: str, time: str, order: str, shard: str) -> DataFrame:
    rows = neighbour(df.select(file, time, order, shard), [file], [time, order], shard, [time], "_b").withColumn("_gap", F.col(time) - F.col(f"_b.{time}"))
    return rows.groupBy(file).agg(F.count("*").alias("n_rows"), F.min(time).alias("first_s"), F.max(time).alias("last_s"), F.count_distinct(time).alias("n_times"),
                                  F.count_if(F.col("_gap") > 5).alias("gaps_5"), F.count_if(F.col("_gap") > 1_800).alias("gaps_1800"), F.max("_gap").alias("max_gap"))


def overlapping_files(df: DataFrame, file: str, time: str, key: list[str], bucket_s: int = 86_400) -> DataFrame:
    """(file_a, file_b, shared): files whose time ranges meet, with the number of shared keys.

    The range join is an equi-join on day buckets; one bucket is charged with a pair, so pairs come once.
    """
    spans = df.groupBy(file).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    cut = spans.withColumn("_b", F.explode(F.sequence(F.expr(f"lo div {bucket_s}"), F.expr(f"hi div {bucket_s}"))))
    a = cut.select(F.col(file).alias("file_a"), F.col("lo").alias("la"), F.col("hi").alias("ha"), "_b")
    b = cut.select(F.col(file).alias("file_b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), "_b")
    meet = (F.col("file_a") < F.col("file_b")) & (F.col("la") <= F.col("hb")) & (F.col("lb") <= F.col("ha")) & (F.col("_b") == F.call_function("div", F.greatest("la", "lb"), F.lit(bucket_s)))
    pairs = a.join(b, "_b").where(meet).select("file_a", "file_b")
    once = df.select(file, *key).distinct()
    held = once.groupBy(*key).agg(F.collect_set(file).alias("_files")).where(F.size("_files") > 1)
    left = held.select(F.monotonically_increasing_id().alias("_i"), F.explode("_files").alias("file_a"), "_files")
    shared = left.select("file_a", F.explode("_files").alias("file_b")).where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("_n"))
    return pairs.join(shared, ["file_a", "file_b"], "left").select("file_a", "file_b", F.coalesce("_n", F.lit(0)).alias("shared"))


def aligned_runs(df: DataFrame, file: str, pos: str, key: list[str], later: Column) -> DataFrame:
    """(file_a, file_b, shift, first_a, last_a, n): maximal runs of consecutive rows of a matched to consecutive rows of b.

    Matches on one diagonal (pos_b - pos_a) that follow each other without a hole are one run.
    """
    a = df.select(F.col(file).alias("file_a"), F.col(pos).alias("pos_a"), *key)
    b = df.where(later).select(F.col(file).alias("file_b"), F.col(pos).alias("pos_b"), *key)
    m = a.join(b, key).where("file_a < file_b").select("file_a", "file_b", "pos_a", (F.col("pos_b") - F.col("pos_a")).alias("shift"))
    w = Window.partitionBy("file_a", "file_b", "shift").orderBy("pos_a")
    return (m.withColumn("_island", F.col("pos_a") - F.row_number().over(w)).groupBy("file_a", "file_b", "shift", "_island")
            .agg(F.min("pos_a").alias("first_a"), F.max("pos_a").alias("last_a"), F.count("*").alias("n")).drop("_island"))


def run_members(df: DataFrame, runs: DataFrame, file: str, pos: str) -> DataFrame:
    """Rows of the later file that lie in a run."""
    places = runs.select(F.col("file_b").alias(file), F.explode(F.sequence(F.col("first_a") + F.col("shift"), F.col("last_a") + F.col("shift"))).alias(pos)).distinct()
    return df.select(file, pos).distinct().join(places, [file, pos], "left_semi")


def roots(edges: DataFrame, copy: str, orig: str, rounds: int = 40) -> DataFrame:
    """(copy, root): the end of the chain copy -> original of each copy, by pointer jumping (doubling each round)."""
    from brackwater.shared import written

    now = edges.groupBy(copy).agg(F.min(orig).alias("root"))
    for _ in range(rounds):
        far = now.select(F.col(copy).alias("_c"), F.col("root").alias("_r"))
        after = written(now.join(far, F.col("root") == F.col("_c"), "left").select(copy, F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        moved = after.where("_moved").limit(1).count()
        now = after.drop("_moved")
        if not moved:
            return now
    raise ValueError("the copies form a circle")


def provenance(df: DataFrame, key: list[str], order: list[str], pos: str) -> DataFrame:
    """Every occurrence of a row with its number, the position of the first, and how many there are."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("occurrence", (F.row_number().over(w) - 1).cast("long")).withColumn("canonical_pos", F.first(pos).over(w))
    return rows.withColumn("n_copies", F.count("*").over(Window.partitionBy(*key))).withColumn("is_canonical", F.col("occurrence") == 0)


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    a, b = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_ina")), new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_inb"))
    both = a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(key, F.when(F.col("_inb").isNull(), "removed").when(F.col("_ina").isNull(), "added").otherwise("modified").alias("change"))


def union_with_membership(sets: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Union of sets by key with one flag a set."""
    out = None
    for name, df in sets.items():
        part = df.select(*key, *[F.lit(other == name).alias(other) for other in sets])
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*key).agg(*[F.bool_or(n).alias(n) for n in sets])


def cross_matches(df: DataFrame, owner: str, key: list[str]) -> DataFrame:
    """(a, b, matched): pairs of owners with the number of keys they share; pairs form inside a key's set of owners."""
    held = df.groupBy(*key).agg(F.collect_set(owner).alias("_o")).where(F.size("_o") > 1)
    return held.select(F.explode("_o").alias("a"), "_o").select("a", F.explode("_o").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("matched"))
