"""Mixing sources to target weights, sized in tokens.

A source's quota is its target share of all tokens, capped by max_repeats copies of everything it has.  The whole copies
in the quota are allocated to every document; the rest is drawn by Pareto order sampling with inclusion probabilities
proportional to size: p = min(1, c * tokens), with c such that the expected tokens are the rest, so that long documents
may be certain.  Documents are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p) and taken
from the top until the rest is used up: the size that is fixed is the number of tokens.  c comes from sums over classes of
sizes, the cut from a histogram of the ranks (both a bounded number of rows a source) and an exact pass over the one cell
that holds it, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm import tokenizer
from brackwater.shared import written

CELLS = 4_096
CLASSES = 8  # of sizes, an octave


def targets(mix: DataFrame) -> DataFrame:
    """One row a source: shares that are null or negative count as 0, a repeat count below 0 or null as 0."""
    clean = mix.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    return clean.select("source", F.greatest(F.coalesce("t.target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
                        F.greatest(F.coalesce("t.max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))


def allocation(sizes: DataFrame, mix: DataFrame) -> DataFrame:
    """Per source of the mix: tokens it has, its quota, whole copies, tokens to draw and inclusion probability."""
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).scalar()
    has = sizes.groupBy("source").agg(F.sum("n_tokens").alias("has"))
    plan = targets(mix).join(has, "source", "left").withColumn("total", total).withColumn("has", F.coalesce("has", F.lit(0)))
    quota = F.least(F.col("target_share") * F.col("total"), (F.col("max_repeats") * F.col("has")).cast("double"))
    plan = plan.withColumn("quota", quota).withColumn("whole", F.when(F.col("has") > 0, F.floor(F.col("quota") / F.col("has"))).otherwise(0))
    return plan.withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("has"), F.lit(0.0)))


def size_class(n_tokens: Column) -> Column:
    return F.floor(F.log2(n_tokens) * CLASSES)


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, c, certain): documents of a class above `certain` are sure, others are in with probability c * tokens.

    Per class, from the greatest down: were all above it sure, c would be (rest - their tokens) / sum of squares of the
    others; the first class for which no probability exceeds one counts.  Without such a class, all are sure.
    """
    rows = sizes.where("n_tokens > 0").withColumn("_class", size_class(F.col("n_tokens")))
    n = F.col("n_tokens").cast("double")
    classes = rows.groupBy("source", "_class").agg(F.sum(n).alias("_sum"), F.sum(n * n).alias("_squares"), F.max(n).alias("_most"))
    classes = classes.join(plan.select(F.col("source").alias("_source"), "rest"), F.col("source") == F.col("_source"))
    down = Window.partitionBy("source").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, 0)
    classes = classes.withColumn("_c", (F.col("rest") - F.coalesce(F.sum("_sum").over(down), F.lit(0.0))) / F.sum("_squares").over(up))
    fits = (F.col("_c") > 0) & (F.col("_c") * F.col("_most") <= 1)
    best = classes.groupBy("source").agg(F.max(F.when(fits, F.struct("_class", "_c"))).alias("_best"))
    return best.select("source", F.coalesce("_best._c", F.lit(0.0)).alias("c"), F.coalesce("_best._class", F.lit(-1)).alias("certain"))


def mixture(documents: DataFrame, mix: DataFrame, seed: int = 17, tokenizer_dir: str = tokenizer.TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document that is in the mixture.

    Defined cases: documents without source, of a source outside the mix, or without tokens are not in it; a document is
    used at most max_repeats times; equal ranks go by doc_id; the draw depends on doc_id and seed only.
    """
    sizes = written(tokenizer.counts(documents, ["doc_id", "source"], tokenizer_dir), "tokens")
    plan = allocation(sizes, mix)
    odds = inclusion(sizes, plan).select(F.col("source").alias("_osource"), "c", "certain")
    plan = plan.join(odds, F.col("source") == F.col("_osource"), "left").select(F.col("source").alias("_source"), "whole", "rest", "c", "certain", "max_repeats")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = sizes.where("n_tokens > 0").withColumn("_u", u)
    rows = rows.join(plan, rows["source"] == F.col("_source"))
    p = F.when((F.col("c") > 0) & (size_class(F.col("n_tokens")) <= F.col("certain")), F.least(F.col("c") * F.col("n_tokens"), F.lit(1.0))).otherwise(1.0)
    rows = rows.withColumn("_p", p).withColumn("_rank", F.when(F.col("_p") < 1, F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))).otherwise(0.0))
    # Ranks lie between nought and infinity; their share of rank and one is cut into cells, those of certain documents by u.
    place = F.col("_rank") / (1 + F.col("_rank"))
    rows = rows.withColumn("_cell", F.when(F.col("_p") < 1, F.floor(place * CELLS)).otherwise(F.floor(F.col("_u") * CELLS) - CELLS))
    cells = rows.groupBy("source", "_cell", "rest").agg(F.sum("n_tokens").alias("_tokens"))
    along = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_tokens").over(along)).select(
        F.col("source").alias("_cs"), F.col("_cell").alias("_cc"), (F.col("_upto") - F.col("_tokens")).alias("_before"), F.col("_upto"), F.col("rest").alias("_rest"))
    rows = rows.join(cells, (F.col("source") == F.col("_cs")) & (F.col("_cell") == F.col("_cc")))
    sure, out = F.col("_upto") <= F.col("_rest"), F.col("_before") >= F.col("_rest")
    cut = Window.partitionBy("source").orderBy("_rank", "_u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(~sure & ~out).withColumn("_sum", F.col("_before") + F.sum("n_tokens").over(cut))
    # The document at the cut is in if that brings the source nearer to its quota.
    edge = edge.withColumn("_in", (F.col("_sum") - F.col("n_tokens") / 2) <= F.col("_rest")).drop("_sum")
    drawn = rows.where(sure | out).withColumn("_in", sure).unionByName(edge)
    copies = F.least(F.col("whole") + F.col("_in").cast("int"), F.col("max_repeats")).cast("int")
    return drawn.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(documents: DataFrame, mix: DataFrame, seed: int = 17, tokenizer_dir: str = tokenizer.TOKENIZER_DIR) -> DataFrame:
    """Per source of the mix: target share, tokens and records it got, and the share of the mixture it really reached."""
    got = mixture(documents, mix, seed, tokenizer_dir).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    table = targets(mix).join(got, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "records", "most_copies")])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row a source of the mix
    return table.withColumn("_all", whole).select("source", "target_share", "max_repeats", "tokens", "records", "most_copies",
                                               F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0).alias("real_share"))
