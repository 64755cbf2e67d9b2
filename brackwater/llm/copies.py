"""Duplicates hidden by formatting differences.

Each normalised (field, value) pair is hashed and the hashes are combined by a commutative multiset hash (sums of 32-bit
halves of two 64-bit hashes), so the order of fields plays no part and nothing is sorted.  Records are grouped by that
fingerprint with map-side partial aggregation over numbers alone; only members of groups above one meet the kept record's
text, and are checked field by field against it.  Members that differ from it (a collision) are grouped again by their
values in the order of the field list.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.shared import written

# The field names of a full record, and those of its text of time and values.
FIELDS = ("subj", "dev", "ts", "p1", "p2", "p3", "p4", "p5", "p6", "temp", "humid", "event")
ST_FIELDS = ("ts", "p1", "p2", "p3", "p4", "p5", "p6", "temp", "humid")
_PAIR, _VALUE, _SIGN, _POINT = "\u0001", "\u0002", "\u0003", "\u0004"
# Full-width forms of the printable ASCII characters, other hyphens and minus signs, and the marks used here.
_FROM = "".join(chr(0xFF01 + i) for i in range(94)) + "‐‑−" + _PAIR + _VALUE + _SIGN + _POINT
_TO = "".join(chr(0x21 + i) for i in range(94)) + "---" + " " * 4
# Characters that may have another canonical form: combining marks, conjoining jamo, compatibility ideographs and signs.
_COMPOSABLE = r"[\p{M}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{F900}-\x{FAFF}\x{1F00}-\x{1FFF}\x{2126}\x{212A}\x{212B}]"
_CLOSE, _OPEN = r"[\p{Pe}\p{Pf}\"'>\s\p{Z}]*", r"[\p{Ps}\p{Pi}\"'<\s\p{Z}]*"
_DELIMITERS = ("->", "=", ":")


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def composed(text: Column) -> Column:
    """Canonical composition; texts without composable characters do not go to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_COMPOSABLE), text)), text)


def _count(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(_PAIR), F.lit("")))


def _marked(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """`_text` with field names and their delimiters as marks.

    A field name stands at the start or after a separator (comma, semicolon, bar, tab, line end) and is followed by the
    delimiter of the text's first field, so that a name inside a value starts no field.  Texts that do not name every
    field that way may part fields by blanks, or mix delimiters: what names more fields counts, the latter on a tie.
    """
    names, any_delimiter, text = "|".join(fields), "|".join(_DELIMITERS), F.col("_text")
    strict, loose = rf"(?i)(?:^|[,;|\n\t]){_OPEN}({names}){_CLOSE}", rf"(?i)(?<![\p{{L}}\p{{N}}])({names}){_CLOSE}"
    mark = lambda pattern: F.regexp_replace(text, pattern, f"{_PAIR}$1{_VALUE}")

    def with_own(pattern: str) -> Column:
        first, *rest = _DELIMITERS
        out = F.when(F.col("_own") == first, mark(pattern + first))
        for d in rest:
            out = out.when(F.col("_own") == d, mark(pattern + d))
        return out.otherwise(text)

    df = df.withColumn("_own", _once(F.regexp_extract(text, rf"{loose}({any_delimiter})", 2))).withColumn("_best", _once(with_own(strict)))
    lacking = _count(F.col("_best")) != len(fields)
    df = df.withColumn("_blanks", _once(F.when(lacking, with_own(loose)))).withColumn("_mixed", _once(F.when(lacking, mark(rf"{strict}(?:{any_delimiter})"))))
    by_blanks = (_count(F.col("_blanks")) == len(fields)) | (_count(F.col("_blanks")) > _count(F.col("_mixed")))
    out = F.when(lacking, F.when(by_blanks, F.col("_blanks")).otherwise(F.col("_mixed"))).otherwise(F.col("_best"))
    return df.withColumn("_text", _once(out)).drop("_own", "_best", "_blanks", "_mixed")


def normalised(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """`_text` as '\\1field\\2value' parts, in the order of the text, behind whatever stood before the first field.

    Of a value stay the letters, digits and combining marks, letter case folded, the sign of a number (a hyphen directly
    before a digit and not after a letter or digit) and its decimal point (a point between two digits).  Without fields
    the whole text is one value without a name.
    """
    # Sharp s has no upper case of its own.
    df = df.withColumn("_text", _once(F.replace(F.translate(composed(F.col("_text")), _FROM, _TO), F.lit("ß"), F.lit("ss"))))
    df = _marked(df, fields) if fields else df.withColumn("_text", F.concat(F.lit(_PAIR + _VALUE), "_text"))
    kept = F.regexp_replace(F.regexp_replace("_text", r"(?<![\p{L}\p{N}])-(?=[0-9])", _SIGN), r"(?<=[0-9])\.(?=[0-9])", _POINT)
    return df.withColumn("_text", _once(F.lower(F.regexp_replace(kept, r"[^\p{L}\p{N}\p{M}\x01-\x04]+", ""))))


def pairs(text: Column) -> Column:
    """The 'field\\2value' pairs of a normalised text; a time has neither sign nor point."""
    parts = F.split(text, _PAIR)
    named = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(named, lambda x: F.when(x.startswith("ts" + _VALUE), F.translate(x, _SIGN + _POINT, "")).otherwise(x))


def fingerprint(items: Column) -> list[Column]:
    """Commutative hash of a multiset of strings, as four whole numbers that cannot overflow."""
    out = []
    for h in (F.transform(items, lambda x: F.xxhash64(x)), F.transform(items, lambda x: F.xxhash64(F.lit(1), x))):
        out.append(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(0xFFFFFFFF))))
        out.append(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, 32)))
    return out


_KEYS = ["_f0", "_f1", "_f2", "_f3"]


def _once(x: Column) -> Column:
    """Keep x as a column of its own, so that its expression is not copied into everything that uses it."""
    return F.when(F.spark_partition_id() >= 0, x)


def same_multiset(a: Column, b: Column) -> Column:
    """Equality of two arrays whatever their order, without sorting: as sets where nothing repeats, else by counts."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    by_set = F.size(F.array_except(a, b)) == 0
    by_count = F.forall(a, lambda x: times(a, x) == times(b, x))
    repeats = F.size(F.array_distinct(a)) < F.size(a)
    return F.when(a == b, True).when(F.size(a) != F.size(b), False).when(repeats, by_count).otherwise(by_set & (F.size(F.array_distinct(b)) == F.size(b)))


def _records(df: DataFrame, key: str, text: str, fields: Sequence[str]) -> DataFrame:
    """(_id, _text, fingerprint) of every record that names a field, written once: grouping reads the fingerprints only."""
    slim = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    slim = normalised(slim, fields).withColumn("_p", _once(pairs(F.col("_text"))))
    rows = slim.select("_id", "_text", *[h.alias(k) for h, k in zip(fingerprint(F.col("_p")), _KEYS, strict=True)])
    return written(rows.where(F.contains("_text", F.lit(_PAIR))), "copies")


def grouped(df: DataFrame, key: str = "record_id", text: str = "full_text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(kept_id, copy_id): every record that is a copy, with the smallest id of its group.

    Defined cases: records without id or text, and texts that name no field, are in no group; a field without value has
    the empty value; a field that a text does not name is not the same as an empty one; a repeated id is one record.
    With no `fields` whole texts are compared, and empty ones are copies of each other.
    """
    rows = _records(df, key, text, fields)
    groups = rows.groupBy(*_KEYS).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = groups.select(*[F.col(k).alias(f"{k}g") for k in _KEYS], "_first")

    def meets(suffix: str) -> Column:
        cond = F.lit(True)
        for k in _KEYS:
            cond = cond & (F.col(k) == F.col(f"{k}{suffix}"))
        return cond

    members = rows.join(groups, meets("g")).select("_id", "_text", "_first", *_KEYS)
    kept = members.where(F.col("_id") == F.col("_first")).groupBy(*_KEYS).agg(F.min("_text").alias("_kept"))
    kept = kept.select(*[F.col(k).alias(f"{k}k") for k in _KEYS], "_kept")
    def values_of(field: str) -> Column:
        return F.array_sort(F.filter("_pairs", lambda x: x.startswith(field + _VALUE)))

    fields_of = F.flatten(F.array(*[values_of(f) for f in fields])) if fields else F.col("_pairs")
    members = members.where(F.col("_id") != F.col("_first")).join(kept, meets("k"))
    same = F.when(F.col("_text") == F.col("_kept"), True).otherwise(same_multiset(pairs(F.col("_text")), pairs(F.col("_kept"))))
    members = members.select("_id", "_first", _once(F.when(~same, pairs(F.col("_text")))).alias("_pairs"))
    members = written(members.select("_id", "_first", fields_of.alias("_fields")), "copy-members")
    copies = members.where(F.col("_fields").isNull()).select(F.col("_first").alias("kept_id"), F.col("_id").alias("copy_id"))
    others = members.where(F.col("_fields").isNotNull())
    first = others.groupBy("_fields").agg(F.min("_id").alias("kept_id"))
    again = others.join(first, "_fields").select("kept_id", F.col("_id").alias("copy_id"))
    return copies.unionByName(again).where("kept_id <> copy_id").distinct()


def collapsed(df: DataFrame, key: str = "record_id", text: str = "full_text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(kept_id, n_copies): one row a reading, n_copies counts the records it stands for, itself included."""
    extra = grouped(df, key, text, fields)
    counts = extra.groupBy("kept_id").agg((F.count("*") + 1).alias("n_copies"))
    ids = df.select(F.col(key).alias("kept_id")).where(F.col("kept_id").isNotNull()).distinct()
    single = ids.join(extra.select(F.col("copy_id").alias("kept_id")), "kept_id", "left_anti")
    return single.join(counts, "kept_id", "left").select("kept_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
