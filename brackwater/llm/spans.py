"""Long exact spans shared between records: seed and extend.

Every window of SPAN code points holds a winnowed anchor, the least hash among its SEED-grams; equal windows have equal
anchors.  Documents are joined on anchors that occur in more than one of them.  There the anchor is extended to both sides
as far as it stays the anchor: to a run of windows, one row with its text.  Runs are compared by their texts; a run that
two documents share is shared as a whole.  Only where one anchor stands in different runs (at the ends of passages) are
the windows of each distinct run compared alone, by two independent 64-bit hashes, of anchor and window.  What is shared
goes back to all places of the run's text, and overlapping pieces are united to maximal stretches.  Grouping keeps the
least and greatest document of a text, aggregated map-side, and never pairs: a passage in a third of all documents costs as
many rows as it has places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.shared import written

SPAN, SEED = 200, 120
BLOCK = 400_000  # code points that are hashed at once; longer texts go in overlapping blocks
RUN = 200  # windows of a run at most; longer ones (of periodic texts) are cut
_SEED_BASE, _SPAN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)])
        return self.up[:n], self.down[:n]


_powers = {b: _Powers(b) for b in (_SEED_BASE, _SPAN_BASE)}


def grams(codes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every stretch of `size` code points, by differences of prefix sums."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers[base].upto(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(base)) * up)])
    return _mix((total[size:] - total[:-size]) * down[:n - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - size:])


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of several texts at once: (codes, row of each window start or -1, its place in the text)."""
    parts: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    places: list[np.ndarray] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(parts), np.concatenate(rows), np.concatenate(places)

    for row, text in enumerate(texts):
        if text is None or len(text) < SPAN:
            continue
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for start in range(0, len(codes) - SPAN + 1, BLOCK):
            piece = codes[start:start + BLOCK + SPAN - 1]
            starts = len(piece) - SPAN + 1
            owner = np.full(len(piece), -1, np.int32)
            owner[:starts] = row
            parts.append(piece)
            rows.append(owner)
            places.append(np.arange(start, start + len(piece), dtype=np.int64))
            size += len(piece)
            if size >= BLOCK:
                yield flush()
                parts, rows, places, size = [], [], [], 0
    if parts:
        yield flush()


def anchors(codes: np.ndarray) -> np.ndarray:
    """For every window of SPAN code points, the least hash of its SEED-grams."""
    return sliding_min(grams(codes, SEED, _SEED_BASE), SPAN - SEED + 1)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc = b.column(0).to_numpy()
        for codes, row, _ in blocks(b.column(1).to_pylist()):
            least = anchors(codes)
            row = row[:len(least)]
            keep = row >= 0
            keep[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(least[keep].view(np.int64)), pa.array(doc[row[keep]])], names=["seed", "doc_id"])


def run_starts(least: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a run of windows of one text with one anchor begins; long runs are cut every RUN windows."""
    fresh = np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(fresh)
    since = np.arange(len(least)) - np.repeat(first, np.diff(np.r_[first, len(least)]))
    return np.flatnonzero(since % RUN == 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        lists = b.column(2)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for codes, row, place in blocks(texts):
            least = anchors(codes).view(np.int64)
            row, place = row[:len(least)], place[:len(least)]
            at = run_starts(least, row)
            size = np.diff(np.r_[at, len(least)])
            shared = np.zeros(len(at), bool)
            owner = row[at]
            cut = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if (r := owner[a]) >= 0:
                    shared[a:z] = np.isin(least[at[a:z]], flat[ends[r]:ends[r + 1]])
            at, size, owner = at[shared], size[shared], owner[shared]
            start = place[at]
            cells = [texts[r][s:s + n + SPAN - 1] for r, s, n in zip(owner.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(least[at]), pa.array(cells, pa.string()), pa.array(doc[owner]), pa.array(start), pa.array(size)], names=["seed", "run", "doc_id", "at", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seed, least, most, rid = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
        for codes, row, place in blocks(b.column(1).to_pylist()):
            full = grams(codes, SPAN, _SPAN_BASE).view(np.int64)
            keep = row[:len(full)] >= 0
            r = row[:len(full)][keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed[r], full[keep], least[r], most[r], rid[r], place[:len(full)][keep])], names=["seed", "full", "least", "most", "rid", "off"])


def shared_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, at, n): n consecutive places of a text, from `at` on, whose next SPAN code points occur in another document."""
    slim = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = slim.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= SPAN))
    seeds = texts.mapInArrow(_seeds, "seed bigint, doc_id bigint")
    common = seeds.groupBy("seed").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most").select(F.col("seed").alias("_seed"))
    of_doc = (seeds.distinct().join(common, F.col("seed") == F.col("_seed")).groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
              .withColumnRenamed("doc_id", "_doc"))
    runs = (texts.join(of_doc, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "seeds")
            .mapInArrow(_runs, "seed bigint, run string, doc_id bigint, at bigint, n bigint").withColumn("rid", F.xxhash64("run")))
    runs = written(runs, "runs")
    distinct = runs.groupBy("seed", "rid", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("n").alias("n"))
    distinct = written(distinct, "distinct-runs")
    columns = [F.col("seed").alias("_seed"), F.col("rid").alias("_rid")]
    whole = distinct.where("least < most").select(*columns, F.lit(0).cast("long").alias("_off"), F.col("n").alias("_n"))
    mixed = distinct.groupBy("seed").agg(F.count("*").alias("_texts")).where("_texts > 1").select(F.col("seed").alias("_seed"))
    ends = distinct.join(mixed, F.col("seed") == F.col("_seed")).select("seed", "run", "least", "most", "rid").mapInArrow(
        _windows, "seed bigint, full bigint, least bigint, most bigint, rid bigint, off bigint")
    repeated = (ends.groupBy("seed", "full").agg(F.min("least").alias("_least"), F.max("most").alias("_most")).where("_least < _most")
                .select(F.col("seed").alias("_seed"), F.col("full").alias("_full")))
    # Windows of runs that are shared as a whole only stand for others here.
    places = ends.where("least = most").join(repeated, (F.col("seed") == F.col("_seed")) & (F.col("full") == F.col("_full"))).select("seed", "rid", "off").distinct()
    island = F.col("off") - F.row_number().over(Window.partitionBy("seed", "rid").orderBy("off"))  # at most RUN rows a run
    pieces = places.withColumn("_island", island).groupBy("seed", "rid", "_island").agg(F.min("off").alias("_off"), F.count("*").alias("_n")).select(*columns, "_off", "_n")
    met = runs.select("seed", "rid", "doc_id", "at").join(whole.unionByName(pieces), (F.col("seed") == F.col("_seed")) & (F.col("rid") == F.col("_rid")))
    return met.select("doc_id", (F.col("at") + F.col("_off")).alias("at"), F.col("_n").alias("n"))


def found(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span_start, span_chars): maximal stretches of a text whose every character lies in a shared span.

    Defined cases: null, empty and shorter texts have no span; copies under the same doc_id are the same document and do
    not make a span shared; rows without doc_id are left out; stretches that touch are one.
    """
    along = Window.partitionBy("doc_id").orderBy("at", "last")
    pieces = shared_runs(documents, key, text).select("doc_id", "at", (F.col("at") + F.col("n") - 1).alias("last")).distinct()
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.coalesce(F.col("at") - reach, F.lit(SPAN + 1)) > SPAN).cast("int")
    united = pieces.withColumn("_new", fresh).withColumn("_no", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return united.groupBy("doc_id", "_no").agg(F.min("at").alias("span_start"), (F.max("last") - F.min("at") + SPAN).alias("span_chars")).drop("_no")


def shares(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document."""
    sizes = documents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(F.coalesce(F.char_length(text), F.lit(0))).alias("n_chars"))
    got = found(documents, key, text).groupBy("doc_id").agg(F.sum("span_chars").alias("_shared"))
    shared = F.coalesce("_shared", F.lit(0))
    return sizes.join(got, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
