"""Sinks with guarded roots, stable small tables, integrity records and a ledger of runs, on any file system Spark knows."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import posixpath
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Small files through Hadoop's file systems, so that a path may lie anywhere the cluster can reach."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.active()
        self.jvm = self.spark._jvm

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_file(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def read(self, path: str) -> bytes:
        fs, at = self._at(path)
        fs.setVerifyChecksum(False)  # a changed file is to be seen, by its digest, and not to be refused
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write beside the place and rename, so that readers see the old file or the new one."""
        part = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{uuid.uuid4().hex}")
        fs, at = self._at(part)
        stream = fs.create(at, True)
        stream.write(bytearray(data))
        stream.close()
        final = self.jvm.org.apache.hadoop.fs.Path(path)
        fs.delete(final, False)
        fs.rename(at, final)

    def remove(self, path: str, recursive: bool = False) -> None:
        fs, at = self._at(path)
        fs.delete(at, recursive)

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def resolved(path: Column) -> Column:
    """A path without '.', '..' and doubled separators, in lower case: two levels of '..' are enough for listed paths."""
    up = r"(^|/)(?!\.\./)[^/]+/\.\./"
    out = F.regexp_replace(F.regexp_replace(path, "//+", "/"), r"/(\./)+", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(out, up, "$1"), up, "$1"))


class Guard:
    """Refuses writes and deletions below protected roots, whatever the spelling of the path."""

    def __init__(self, protected: list[str]) -> None:
        self.protected = [self._real(p) for p in protected]

    @staticmethod
    def _real(path: str) -> str:
        scheme, rest = re.fullmatch(r"(?s)(?:([a-z0-9]+):(?=/))?(.*)", path).groups()  # type: ignore[union-attr]
        if scheme in (None, "file"):
            return os.path.realpath(rest).casefold()
        return f"{scheme}:{posixpath.normpath(rest)}".casefold()

    def is_protected(self, path: str) -> bool:
        p = self._real(path)
        return any(p == root or p.startswith(root.rstrip("/") + "/") for root in self.protected)

    def check(self, path: str) -> str:
        if self.is_protected(path):
            raise PermissionError(f"{path} lies in a protected folder")
        return path

    def remove(self, path: str) -> None:
        """Delete one regular file outside the protected roots."""
        self.check(path)
        store = Store()
        if not store.is_file(path) or os.path.islink(path):
            raise ValueError(f"{path} is no regular file")
        store.remove(path)


def write_parquet(df: DataFrame, path: str, guard: Guard, order: list[str] | None = None) -> None:
    """Compressed Parquet, range-partitioned and sorted by `order` so that readers can skip row groups."""
    guard.check(path)
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, guard: Guard, columns: list[str], most_rows: int = 100_000) -> str:
    """One byte-stable CSV of a small result table; its SHA-256.  Other columns and more rows than allowed are errors."""
    guard.check(path)
    if set(df.columns) != set(columns):
        raise ValueError(f"columns {df.columns} instead of {columns}")
    rows = df.select(*columns).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows are no small table; write Parquet")
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(sorted((["" if v is None else v for v in r] for r in rows), key=lambda r: [str(v) for v in r]))
    data = text.getvalue().encode()
    Store(df.sparkSession).write(path, data)
    return hashlib.sha256(data).hexdigest()


def write_json(path: str, value: object, guard: Guard) -> str:
    """Indented JSON in UTF-8 with plain line ends; its SHA-256."""
    data = (json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n").encode()
    Store().write(guard.check(path), data)
    return hashlib.sha256(data).hexdigest()


def write_lines(df: DataFrame, folder: str, guard: Guard, key: str, order: list[str], text: str) -> None:
    """One text file a key, its lines in order; the text is written as its bytes are."""
    guard.check(folder)
    rows = df.select(F.col(key).alias("key"), *order, F.col(text).cast("string").alias("value")).repartition("key").sortWithinPartitions("key", *order)
    rows.select("key", "value").write.partitionBy("key").text(folder)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV scan: the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def digests(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def record(spark: SparkSession, folder: str, manifest: str) -> None:
    """Write the digests of all files of a folder as a table: (name, sha256)."""
    named = digests(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sha256")
    named.where(F.col("name").endswith(".parquet")).write.parquet(manifest)


def verified_parquet(spark: SparkSession, path: str, expected: dict[str, str] | DataFrame) -> DataFrame:
    """Read a table only if every file has the recorded SHA-256 (by file name); the digests are compared where they are made."""
    if isinstance(expected, dict):
        expected = spark.createDataFrame(list(expected.items()), "name string, sha256 string")
    have = digests(spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sha256").where(F.col("name").endswith(".parquet"))
    other = have.join(expected.withColumnRenamed("sha256", "_recorded"), "name", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("_recorded")))
    if wrong := [r["name"] for r in other.select("name").limit(5).collect()]:
        raise ValueError(f"files differ from the record, such as {sorted(wrong)}")
    return spark.read.parquet(path)


class Ledger:
    """State of runs: complete only if the record says so and every artifact still has its digest; attempts are kept."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.store = Store()

    def _path(self, run: str) -> str:
        return f"{self.folder}/{run}.json"

    def read(self, run: str) -> dict:
        return json.loads(self.store.read(self._path(run))) if self.store.exists(self._path(run)) else {"run": run, "status": "new", "attempts": []}

    def _write(self, run: str, record: dict) -> None:
        self.store.write(self._path(run), json.dumps(record, sort_keys=True).encode())

    def _digest(self, path: str) -> str:
        return hashlib.sha256(self.store.read(path)).hexdigest()

    def status(self, run: str) -> str:
        record = self.read(run)
        if record["status"] != "complete":
            return record["status"]
        return "complete" if all(self.store.exists(p) and self._digest(p) == h for p, h in record["artifacts"].items()) else "broken"

    def begin(self, run: str, settings: dict) -> None:
        record = self.read(run)
        if record.get("settings") not in (None, settings):
            raise ValueError("the settings of a run are frozen at its first attempt: " + "; ".join(frozen(record["settings"], settings)))
        record |= {"status": "running", "settings": settings, "attempts": [*record["attempts"], {"began": time.time()}]}
        self._write(run, record)

    def complete(self, run: str, artifacts: list[str]) -> None:
        record = self.read(run)
        record |= {"status": "complete", "artifacts": {p: self._digest(p) for p in artifacts}}
        self._write(run, record)

    def fail(self, run: str, why: str) -> None:
        record = self.read(run)
        record["attempts"][-1]["failed"] = why
        self._write(run, record | {"status": "failed"})

    def index(self, spark: SparkSession) -> DataFrame:
        """One row a run: the records are read as a table, the artifacts' digests are taken by the workers."""
        records = spark.read.schema("run string, status string, attempts array<struct<began: double>>, artifacts map<string,string>").json(f"{self.folder}/*.json")
        wanted = records.select("run", F.explode_outer("artifacts").alias("path", "want")).withColumn("path", F.regexp_replace("path", "^file:", ""))
        paths = [p for run in self.store.names(self.folder) if run.endswith(".json") for p in self.read(run[:-5]).get("artifacts", {}) if self.store.exists(p)]
        empty = spark.createDataFrame([], "path string, sha256 string")
        have = spark.read.format("binaryFile").load(sorted(set(paths))).select(F.regexp_replace("path", "^file:", "").alias("path"), F.sha2("content", 256).alias("sha256")) if paths else empty
        intact = wanted.join(have, "path", "left").groupBy("run").agg(F.coalesce(F.bool_and(F.col("sha256").eqNullSafe(F.col("want")) | F.col("path").isNull()), F.lit(True)).alias("_intact"))
        state = F.when((F.col("status") == "complete") & ~F.col("_intact"), "broken").otherwise(F.col("status"))
        return records.join(intact, "run").select("run", state.alias("status"), F.size("attempts").alias("attempts"))


def log_access(accesses: DataFrame, folder: str, guard: Guard) -> None:
    """Append one JSON line an access; nothing that is logged is ever written again."""
    accesses.write.mode("append").json(guard.check(folder))


def frozen(expected: object, given: object, path: str = "", allowed: dict[str, str] | None = None) -> list[str]:
    """Differences of two nested settings, lists included, as readable paths; an empty list means equal.

    allowed: values of the first that may stand as another value in the second.
    """
    out: list[str] = []
    if isinstance(expected, dict) and isinstance(given, dict):
        for key in sorted(set(expected) | set(given), key=str):
            at = f"{path}.{key}".lstrip(".")
            if key not in given or key not in expected:
                out.append(f"{at} is {'missing' if key not in given else 'new'}")
            else:
                out += frozen(expected[key], given[key], at, allowed)
    elif isinstance(expected, list) and isinstance(given, list):
        if len(expected) != len(given):
            out.append(f"{path} has {len(given)} instead of {len(expected)} items")
        for i, (a, b) in enumerate(zip(expected, given, strict=False)):
            out += frozen(a, b, f"{path}[{i}]", allowed)
    elif expected != given and (allowed or {}).get(str(expected), expected) != given:
        out.append(f"{path}: {expected!r} became {given!r}")
    return out


def setting_differences(expected: DataFrame, given: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, field, expected, given) of every setting that differs, or that stands on one side only."""
    flat = lambda df, n: df.select(key, *[F.col(v).cast("string").alias(v) for v in values]).unpivot([key], values, "field", n)
    return flat(expected, "expected").join(flat(given, "given"), [key, "field"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("given")))
