"""Schemas that drift between files: one consistent table, and a report of every change.

A file's header is parsed once into fields (by an alias table), the header in force of a file without one is carried
along its source by a two-level scan, and lines are enforced onto the target schema.  What the target does not know, and
values that cannot be cast, are kept as JSON in a rescue column; `promote` replays rescued values into typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.shared import DAY_US, epoch_us, floor_div, sharded_previous

TARGET = {"ts": "string", "device_id": "string", "p1": "int", "p2": "int", "p3": "int", "p4": "int", "p5": "int", "p6": "int",
          "temp": "double", "humid": "double", "event": "string"}
DATA_LINE = r"^[\s\p{Z}]*\d{2,4}-\d{2}"
INT, DECIMAL = r"^-?[0-9]+$", r"^-?[0-9]+(\.[0-9]+)?$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def fields_of(text: Column, sep: Column) -> Column:
    """Split at separators outside quotes."""
    outside = F.concat(F.lit(r"\Q"), sep, F.lit(r'\E(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return F.call_function("split", text, outside)


def unquote(x: Column) -> Column:
    x = strip(x)
    inner = F.regexp_replace(F.regexp_extract(x, r'(?s)^"(.*)"$', 1), '""', '"')
    return F.when(x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), inner).otherwise(x)


def header_name(x: Column) -> Column:
    """A header's name without byte order mark, quotes, outer blanks and letter case."""
    return F.lower(strip(F.regexp_replace(strip(x), r"^[\s\"\x{FEFF}]+|[\s\"]+$", "")))


def distinct_files(files: DataFrame) -> DataFrame:
    """One row a file (the earliest listing), with the shard and order of the two-level scan; no source is a source."""
    rest = [c for c in ("source_id", "subject_id", "device_id", "sep", "headers", "field_types") if c in files.columns]
    one = (files.where(F.col("file_id").isNotNull())
           .groupBy("file_id").agg(F.min(F.struct(F.col("uploaded_at"), *rest)).alias("_f")).select("file_id", "_f.*"))
    return one.withColumn("_us", F.coalesce(epoch_us(F.col("uploaded_at")), F.lit(0))).withColumn("_day", floor_div(F.col("_us"), DAY_US))


def header_in_force(files: DataFrame) -> DataFrame:
    """Add in_force and in_force_types: a file's own header, else that of the last earlier file of its source that has one."""
    one = distinct_files(files).withColumn("_own", F.when(F.col("headers").isNotNull(), F.struct("headers", "field_types")))
    seen = sharded_previous(one, ["source_id"], ["_us", "file_id"], "_day", "_own", "_before")
    force = F.coalesce("_own", "_before")
    return seen.withColumn("in_force", force["headers"]).withColumn("in_force_types", force["field_types"]).drop("_us", "_day", "_own", "_before")


def header_fields(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, pos, name, type, field) of every file with a header; a name without alias is its own field."""
    known = aliases.where(F.col("alias").isNotNull()).groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("field").alias("_field"))
    flat = (files.where(F.col("headers").isNotNull())
            .select("file_id", F.split(F.col("field_types"), ",").alias("_types"), F.posexplode(fields_of(F.col("headers"), F.col("sep"))).alias("pos", "_raw"))
            .select("file_id", "pos", header_name(F.col("_raw")).alias("name"), F.lower(F.trim(F.try_element_at(F.col("_types"), F.col("pos") + 1))).alias("type")))
    return flat.join(known, flat["name"] == known["_alias"], "left").select("file_id", "pos", "name", "type", F.coalesce("_field", "name").alias("field"))


def changes(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, change_kind, field): each file with a header against the last earlier one with a header of its source.

    Defined cases: a file listed twice counts once; a field named twice in a header counts where it stands first; a null
    type is no type to compare; files without upload time come before all others, equal times go by file_id.
    """
    one = distinct_files(files).where(F.col("headers").isNotNull())
    pairs = sharded_previous(one, ["source_id"], ["_us", "file_id"], "_day", "file_id", "_before").where(F.col("_before").isNotNull())
    pairs = pairs.select(F.col("file_id").alias("_now"), F.col("_before"))
    fields = (header_fields(one, aliases).groupBy("file_id", "field").agg(F.min(F.struct("pos", "name", "type")).alias("_h"))
              .select("file_id", "field", "_h.name", "_h.type"))
    now = pairs.join(fields, pairs["_now"] == fields["file_id"]).select(F.col("_now"), "field", F.struct("name", "type").alias("_n"))
    old = pairs.join(fields, pairs["_before"] == fields["file_id"]).select(F.col("_now"), "field", F.struct("name", "type").alias("_o"))
    both = now.join(old, ["_now", "field"], "full_outer")
    kinds = F.array(F.when(F.col("_o").isNull(), "added"), F.when(F.col("_n").isNull(), "removed"),
                    F.when(F.col("_n.name") != F.col("_o.name"), "renamed"), F.when(F.col("_n.type") != F.col("_o.type"), "retyped"))
    return both.select(F.col("_now").alias("file_id"), F.explode(F.array_compact(kinds)).alias("change_kind"), "field")


def ingest(lines: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every data line as one row of TARGET plus `rescued`, a JSON object of unknown fields, uncastable values and surplus.

    Defined cases: null lines and lines that are no data are left out; a file without any header in force, or one that is
    not listed, puts the whole line into `rescued`; empty values are null; later values of a field named
    twice are rescued as field_2, field_3 and so on.
    """
    forced = header_in_force(files)
    header = forced.select("file_id", F.col("in_force").alias("headers"), F.lit(None).cast("string").alias("field_types"), "sep")
    layout = (header_fields(header, aliases).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("_layout"))
              .select(F.col("file_id").alias("_file"), F.transform("_layout", lambda x: x["field"]).alias("_named")))
    times = lambda x, i: F.size(F.filter(F.slice("_named", F.lit(1), i + 1), lambda y: y == x))
    layout = layout.select("_file", F.transform("_named", lambda x, i: F.when(times(x, i) > 1, F.concat_ws("_", x, times(x, i).cast("string"))).otherwise(x)).alias("_fields"))
    layout = layout.join(forced.select(F.col("file_id").alias("_f2"), F.col("sep").alias("_sep")), F.col("_file") == F.col("_f2")).drop("_f2")
    data = lines.select("line_id", "file_id", "line_no", F.col("line").alias("_line")).where(F.col("_line").rlike(DATA_LINE))
    cut = data.join(layout, data["file_id"] == layout["_file"], "left").withColumn("_v", fields_of(F.col("_line"), F.col("_sep")))
    cells = F.transform(F.arrays_zip(F.col("_fields").alias("f"), F.col("_v").alias("v")),
                        lambda x, i: F.struct(F.coalesce(x["f"], F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("key"), F.nullif(unquote(x["v"]), F.lit("")).alias("value")))
    cut = cut.withColumn("_cells", F.when(F.col("_fields").isNull(), F.array(F.struct(F.lit("line").alias("key"), F.col("_line").alias("value")))).otherwise(cells))

    def first(field: str) -> Column:
        return F.try_element_at(F.filter("_cells", lambda x: x["key"] == field), F.lit(1))["value"]

    def fits(field: str, value: Column) -> Column:
        kind = TARGET[field]
        return F.lit(True) if kind == "string" else value.rlike(INT if kind == "int" else DECIMAL)

    typed = {f: F.when(fits(f, first(f)), first(f)).try_cast(kind) for f, kind in TARGET.items()}
    whole, decimal = [f for f, k in TARGET.items() if k == "int"], [f for f, k in TARGET.items() if k == "double"]
    misfit = lambda x: (~x["key"].isin(list(TARGET)) | x["key"].isin(whole) & ~(x["value"].rlike(INT) & x["value"].try_cast("int").isNotNull())
                        | x["key"].isin(decimal) & ~x["value"].rlike(DECIMAL))
    kept = F.filter("_cells", lambda x: x["value"].isNotNull() & misfit(x))
    rescued = F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform(kept, lambda x: x["key"])),
                     lambda k: F.struct(k.alias("key"), F.try_element_at(F.filter(kept, lambda x: x["key"] == k), F.lit(1))["value"].alias("value"))))))
    return cut.select("line_id", "file_id", "line_no", *[v.alias(k) for k, v in typed.items()], rescued.alias("rescued"))


# Fields that are known beside the target, and their types: approved for promotion.
APPROVED = {"battery": "int", "rssi": "int", "uptime": "long", "fan": "int", "heater": "int", "firmware": "string"}


def promoted(lines: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The consistent table with the approved fields promoted out of `rescued`."""
    return promote(ingest(lines, files, aliases), APPROVED)


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Replay rescued values of approved fields into typed columns; what still cannot be cast stays in `rescued`."""
    out = table
    held = F.from_json("rescued", "map<string,string>")
    for field, kind in approved.items():
        out = out.withColumn(field, held[field].try_cast(kind))
    left = F.map_filter(held, lambda k, v: ~(k.isin(list(approved))) | F.coalesce(*[F.when(k == f, v.try_cast(t).isNull()) for f, t in approved.items()], F.lit(True)))
    return out.withColumn("rescued", F.when(F.size(left) > 0, F.to_json(left)))
