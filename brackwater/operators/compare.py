"""Text scans, release checks, table comparison and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What must not be in released text.
PATTERNS = {"date": r"\b\d{4}-\d{2}-\d{2}\b", "long_id": r"\b\d{9,}\b", "absolute_path": r"(^|\s)/[a-z]+/", "mail": r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+"}
HASH = r"\b[0-9a-f]{32,64}\b"


def text_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding): patterns that occur in a text once hashes are masked."""
    masked = F.regexp_replace(text, HASH, "<hash>")
    hits = F.array_compact(F.array(*[F.when(masked.rlike(p), n) for n, p in PATTERNS.items()]))
    return df.select(key, F.explode(hits).alias("finding"))


def table_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, column, a, b) of every cell that differs; rows on one side only differ in all their cells."""
    cast = lambda x, n: x.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "column", n)
    both = cast(a, "a").join(cast(b, "b"), [*keys, "column"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return both.where(~same)


def within(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Absolute tolerance; nulls and NaN never pass."""
    return F.coalesce((F.abs(a - b) <= tolerance) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def one_cell(df: DataFrame, condition: Column, column: str):
    """The value of the one row that meets the condition; anything else is an error."""
    rows = df.where(condition).select(column).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows) or 'no'} rows meet the condition, one was expected")
    return rows[0][0]


def unique_cells(cells: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column, outcome): the cell of every key that has exactly one, else null with outcome none or many."""
    n = cells.groupBy(*keys).agg(F.count(column).alias("_n"), F.min(column).alias("_cell"))
    outcome = F.when(F.col("_n") == 1, "one").when(F.col("_n") == 0, "none").otherwise("many")
    return n.select(*keys, F.when(F.col("_n") == 1, F.col("_cell")).alias(column), outcome.alias("outcome"))


def untraceable(printed: DataFrame, cells: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """(keys, printed, cell): printed numbers that their declared cell does not give at the printed precision, or that have none."""
    both = printed.join(cells, keys, "left")
    return both.where(~F.round("printed", digits).eqNullSafe(F.round("cell", digits))).select(*keys, "printed", "cell")


def digest(df: DataFrame) -> DataFrame:
    """(rows_in, digest): content digest of a table that does not depend on order; one aggregate, combined map-side."""
    return df.agg(F.count("*").alias("rows_in"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))
