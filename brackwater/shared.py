"""Tables, the shared folder for cut lineage, epoch arithmetic and the two-level ordered scans.

The ordered scans (`sharded_previous`) never sort a whole key in one task: a key is cut into time shards, each shard is
scanned alone, and only one summary row a shard is ordered over the whole key.  The number of shards of a key is bounded
by the calendar (a century of days is 36,525), not by the number of rows.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DAY_S = 86_400
DAY_US = DAY_S * 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Without that setting only a local session, whose driver is its only executor, has one."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"/tmp/brackwater-{os.getpid()}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df into the shared folder and read it back with the same schema; `drop_tables` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brackwater-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_local() -> None:
    shutil.rmtree(f"/tmp/brackwater-{os.getpid()}", ignore_errors=True)


def drop_tables() -> int:
    """Delete the tables that `written` made in this process, once their results have been used; their number."""
    n = len(_tables)
    while _tables:
        spark, path = _tables.pop()
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def epoch_us(ts: Column) -> Column:
    """Microseconds of a zone-less time counted as if it were UTC, whatever the session's zone is."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone", "") in ("UTC", "Etc/UTC", "GMT"):
        return F.unix_micros(ts.cast("timestamp"))
    whole = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return (whole * 1_000_000 + (F.extract(F.lit("SECONDS"), ts) * 1_000_000).cast("long")).cast("long")


def epoch_s(ts: Column) -> Column:
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def floor_div(a: Column, b: Column | int) -> Column:
    """Whole-number floor division (Spark's div cuts toward zero)."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b).cast("long")


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def sharded_previous(df: DataFrame, keys: list[str], order: list[str], shard: str, payload: str, out: str, ahead: bool = False) -> DataFrame:
    """Add `out`: the last non-null `payload` strictly before each row of its key by `order`; null if there is none.

    With `ahead`, the first one strictly after it.  `shard` must not decrease with `order` inside a key.  Rows of a shard
    are scanned in one task, keys are not.
    """
    marked = df.withColumn("_here", F.struct(*order))
    pick = F.first if ahead else F.last
    reach = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    local = marked.withColumn("_prev", pick(payload, ignorenulls=True).over(Window.partitionBy(*keys, shard).orderBy(*order).rowsBetween(*reach))).drop("_here")
    held = F.when(F.col(payload).isNotNull(), F.col("_here"))
    edge = (F.min_by if ahead else F.max_by)(payload, held)
    names = [f"_k{i}" for i in range(len(keys) + 1)]
    ends = marked.groupBy(*keys, shard).agg(edge.alias("_edge")).select(*[F.col(k).alias(n) for n, k in zip(names, [*keys, shard], strict=True)], "_edge")
    over = Window.partitionBy(*names[:-1]).orderBy(names[-1]).rowsBetween(*reach)
    carry = ends.select(*names, pick("_edge", ignorenulls=True).over(over).alias("_carry")).where(F.col("_carry").isNotNull())
    cond = F.lit(True)
    for n, k in zip(names, [*keys, shard], strict=True):
        cond = cond & F.col(n).eqNullSafe(local[k])
    return local.join(carry, cond, "left").select(*[local[c] for c in df.columns], F.coalesce("_prev", "_carry").alias(out))


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
