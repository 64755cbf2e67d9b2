"""Raw log files: listing, decoding with fallback, lines with their chunk keys, and the source of a path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENCODINGS = ("utf-8-sig", "cp949")
_CHUNK = re.compile(r'^\s*"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})"\s*:')
LINES = "path string, encoding string, has_bom boolean, line_no int, line string, chunk_key string"


def decode(raw: bytes) -> tuple[str, str]:
    """Text and the encoding that won; what no encoding reads is replaced."""
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8-replace"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            text, encoding = decode(bytes(content))
            key, rows = None, []
            lines = text.split("\n")
            for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):  # a line end at the end of the file begins no line
                if m := _CHUNK.match(line):
                    key = m[1]
                rows.append((path, encoding, bytes(content[:3]) == b"\xef\xbb\xbf", i, line, key))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["path", "encoding", "has_bom", "line_no", "line", "chunk_key"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "encoding", "has_bom", "line_no", "line", "chunk_key"])


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every physical line of every file below root; a file is one task's work, files are spread.  Empty files have no line."""
    return listing(spark, root, "path", "content").mapInPandas(_lines, LINES)


def listing(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(*columns) if columns else files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def normalised_digest(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every file after CRLF -> LF."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n")
    return listing(spark, root, "path", "content").select("path", F.sha2(text, 256).alias("sha256"))


def resolve_sources(files: DataFrame, prefixes: DataFrame, path: str, prefix: str, source: str) -> DataFrame:
    """The source with the longest prefix of each path, as an equi-join on every prefix length that occurs in the list.

    Prefixes are configured folders, a short list; a path is exploded into as many candidates as there are lengths.
    """
    lengths = prefixes.select(F.length(prefix).alias("_n")).distinct().agg(F.collect_list("_n")).scalar()
    cut = files.withColumn("_n", F.explode(lengths)).where(F.col("_n") <= F.length(path))
    cut = cut.withColumn("_p", F.substring(F.col(path), F.lit(1), F.col("_n")))
    met = cut.join(prefixes.select(F.col(prefix).alias("_p"), F.col(source).alias("_s")).distinct(), "_p")
    w = Window.partitionBy(path).orderBy(F.desc("_n"), "_s")
    return met.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").select(*files.columns, F.col("_s").alias(source))
