"""The row operators on streams: quality flags row by row, sessions and bins with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brackwater.functions import quality


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is given."""
    return spark.readStream.schema(schema).parquet(path)


def flagged(rows: DataFrame) -> DataFrame:
    """Quality flags; stateless."""
    p = [F.col(f"p{i}").cast("long") for i in range(1, 7)]
    return rows.withColumn("target_flag", quality.target_quality(F.col("temp"), F.col("humid"))).withColumn("pressure_flag", quality.pressure_quality(p, F.coalesce(*p).isNotNull()))


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with their event time `at` and its watermark; a watermark that is there already stays."""
    if "at" in rows.columns:
        return rows
    return rows.withColumn("at", F.col("ts").cast("timestamp")).where("at is not null").withWatermark("at", late)


def without_copies(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows sent again under another row id, dropped as long as the watermark remembers the first."""
    return _timed(rows, late).dropDuplicatesWithinWatermark(["subject_id", "device_id", "at"])


def sessions(rows: DataFrame, gap: str = "1800 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of each series once the watermark has passed them: first and last time and number of rows."""
    timed = _timed(rows, late)
    g = timed.groupBy("subject_id", "device_id", F.session_window("at", gap)).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_rows"))
    return g.select("subject_id", "device_id", F.unix_seconds("first_at").alias("start_s"), F.unix_seconds("last_at").alias("end_s"), "n_rows")


def binned(rows: DataFrame, bin_s: int, late: str = "1 hour") -> DataFrame:
    """Means of each series and bin."""
    timed = _timed(rows, late)
    g = timed.groupBy("subject_id", "device_id", F.window("at", f"{bin_s} seconds")).agg(F.count("*").alias("n_rows"), F.avg("temp").alias("temp"), F.avg("humid").alias("humid"))
    return g.select("subject_id", "device_id", F.unix_seconds("window.start").alias("bin_start_s"), "n_rows", "temp", "humid")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Exactly-once Parquet sink; processes what is there and ends."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
