"""Held-out-subject and chronological splits, and the queries that must stay empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(units: DataFrame, subject: str) -> DataFrame:
    """Every unit once a fold; a fold tests one subject.  Folds are as many as subjects, a small table."""
    folds = units.agg(F.collect_set(subject)).scalar()
    return units.withColumn("fold", F.explode(folds)).withColumn("part", F.when(F.col(subject) == F.col("fold"), "test").otherwise("train"))


def inner_swaps(units: DataFrame, subject: str) -> DataFrame:
    """Of each fold's training subjects, each in turn validates and the others train; the held-out subject is absent."""
    train = held_out(units, subject).where("part = 'train'").drop("part")
    roles = train.select("fold", F.col(subject).alias("validated")).distinct()
    return train.join(roles, "fold").withColumn("role", F.when(F.col(subject) == F.col("validated"), "validate").otherwise("train"))


def chronological(ordinals: DataFrame, budgets: list[int], primary_from: int = 16) -> DataFrame:
    """Nights up to the budget adapt, the next one is a buffer, later ones test; budget 0 tests all."""
    b = F.explode(F.array(*[F.lit(x) for x in budgets]))
    rows = ordinals.withColumn("budget", b)
    part = F.when(F.col("budget") == 0, "test").when(F.col("ordinal") <= F.col("budget"), "adapt").when(F.col("ordinal") == F.col("budget") + 1, "buffer").otherwise("test")
    return rows.withColumn("part", part).withColumn("is_primary", (part == "test") & (F.col("ordinal") >= primary_from))


def gate(checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(check_name, violations): one row a check; a check passes if its query is empty."""
    out = None
    for name, violations in checks.items():
        row = violations().agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def require(gated: DataFrame) -> None:
    """Raise unless every check is empty; a check that fails to run raises by itself."""
    bad = [f"{r['check_name']}: {r['violations']}" for r in gated.where("violations > 0").collect()]  # one row a check
    if bad:
        raise ValueError("; ".join(bad))
