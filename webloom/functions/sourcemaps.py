"""Source maps: discovery, validation, VLQ mappings and source extraction, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.paths import source_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# Sources that are no files of the site.
EXCLUDED = (r"^\(webpack\)", r"^__vite", r"^vite/", r"^\?", r"^data:")
SCHEMA = "version INT, file STRING, sourceRoot STRING, sources ARRAY<STRING>, sourcesContent ARRAY<STRING>, names ARRAY<STRING>, mappings STRING, ignoreList ARRAY<INT>"


def included(path: Column) -> Column:
    """F-01: whether a source path is a file of the site."""
    keep = ~path.contains("\0")
    for pattern in EXCLUDED:
        keep = keep & ~path.rlike(pattern)
    return keep


def decode_data_uri(uri: Column) -> Column:
    """C-27: the text of a base64 JSON data URI, or null."""
    body = F.regexp_extract(uri, r"^data:application/json;base64,([A-Za-z0-9+/]*={0,2})$", 1)
    return F.when(uri.rlike(r"^data:application/json;base64,[A-Za-z0-9+/]*={0,2}$"), F.decode(F.try_to_binary(body, F.lit("base64")), "utf-8"))


def map_url_in_headers(headers: Column) -> Column:
    """P-01: the map that response headers name."""
    low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(F.try_element_at(low, F.lit("sourcemap")), F.try_element_at(low, F.lit("x-sourcemap")))


def map_url_at_end(text: Column) -> Column:
    """P-03: the map that a comment at the very end names."""
    return F.nullif(F.regexp_extract(text, r"(?://[#@]\s*sourceMappingURL=|/\*[#@]\s*sourceMappingURL=)([^\s*]+)\s*(?:\*/)?\s*$", 1), F.lit(""))


def valid_content_type(kind: Column) -> Column:
    """F-06: whether a response may be a source map: anything but HTML."""
    return F.when(kind.isNull() | (F.trim(kind) == ""), True).otherwise(~F.lower(kind).contains("text/html"))


def vlq(segment: Column) -> Column:
    """P-10: the numbers of a VLQ segment; null if a character is not in the alphabet or the last number is open."""
    codes = F.transform(F.split(segment, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("shift"), F.lit(False).alias("open"))

    def step(acc: Column, code: Column) -> Column:
        value = acc["value"] + F.call_function("shiftleft", code.bitwiseAND(F.lit(31)).cast("bigint"), F.least(acc["shift"], F.lit(55)))
        number = F.when(value.bitwiseAND(F.lit(1).cast("bigint")) == 1, -F.shiftright(value, 1)).otherwise(F.shiftright(value, 1))
        more = code >= 32
        return F.struct(
            F.when(more, acc["out"]).otherwise(F.concat(acc["out"], F.array(number))).alias("out"),
            F.when(more, value).otherwise(F.lit(0).cast("bigint")).alias("value"),
            F.when(more, acc["shift"] + 5).otherwise(F.lit(0)).alias("shift"),
            more.alias("open"),
        )

    done = F.aggregate(codes, zero, step)
    return F.when(segment.rlike(r"^[A-Za-z0-9+/]+$") & ~done["open"], done["out"])


def mapping_rows(maps: DataFrame) -> DataFrame:
    """P-11, W-02: (map_id, line, seg, column, source, src_line, src_column, name) of ``maps`` (map_id, mappings).

    Columns add up within a line, the other fields over the whole map: two windows over
    exploded segments. Segments that are not of 1, 4 or 5 numbers are left out.
    """
    lines = maps.select("map_id", F.posexplode(F.split("mappings", ";")).alias("line", "text"))
    segs = lines.select("map_id", "line", F.posexplode(F.split("text", ",")).alias("seg", "text")).where("text <> ''")
    segs = segs.withColumn("f", vlq(F.col("text"))).where(F.size("f").isin(1, 4, 5))
    in_line = Window.partitionBy("map_id", "line").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    in_map = Window.partitionBy("map_id").orderBy("line", "seg").rowsBetween(Window.unboundedPreceding, 0)
    field = lambda i, w: F.sum(F.coalesce(F.get("f", F.lit(i)), F.lit(0))).over(w)
    has = lambda n, c: F.when(F.size("f") >= n, c)
    return segs.select("map_id", "line", "seg", field(0, in_line).alias("column"), has(4, field(1, in_map)).alias("source"), has(4, field(2, in_map)).alias("src_line"), has(4, field(3, in_map)).alias("src_column"), has(5, field(4, in_map)).alias("name"))


def validation_codes(text: Column) -> Column:
    """P-04..P-07: codes of all that is wrong with a map's JSON, in the order of the checks."""
    v = F.try_parse_json(text)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    present = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    is_object = F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT")
    version = F.try_variant_get(v, "$.version", "double")
    number = kind("$.version").rlike("BIGINT|DOUBLE|DECIMAL")
    checks = [
        F.when(~present("$.version"), "MISSING_VERSION").when(~number | (version != 3), "INVALID_VERSION"),
        F.when(~present("$.sources"), "MISSING_SOURCES").when(~kind("$.sources").startswith("ARRAY"), "SOURCES_NOT_ARRAY"),
        F.when(~present("$.mappings"), "MISSING_MAPPINGS").when(kind("$.mappings") != "STRING", "INVALID_MAPPINGS"),
        F.when(present("$.names") & ~kind("$.names").startswith("ARRAY"), "INVALID_NAMES"),
        F.when(present("$.sourceRoot") & (kind("$.sourceRoot") != "STRING"), "INVALID_SOURCE_ROOT"),
    ]
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return F.when(v.isNull() | ~is_object, F.array(F.lit("INVALID_JSON"))).otherwise(found)


def extract(maps: DataFrame) -> DataFrame:
    """P-12, J-01: (map_id, src_idx, path, content, status) of ``maps`` (map_id, json): each source with its
    content by position; status tells extracted sources from skipped ones and from those without content."""
    m = maps.select("map_id", F.from_json("json", SCHEMA).alias("m"))
    rows = m.select("map_id", F.col("m.sourceRoot").alias("root"), F.posexplode(F.arrays_zip(F.col("m.sources").alias("path"), F.coalesce(F.col("m.sourcesContent"), F.array().cast("array<string>")).alias("content"))).alias("src_idx", "s"))
    path = source_path(F.col("s.path"), F.coalesce("root", F.lit("")))
    status = F.when(F.col("s.path").isNull() | F.col("s.content").isNull(), "null_content").when(~included(F.col("s.path")), "skipped").otherwise("extracted")
    return rows.select("map_id", "src_idx", path.alias("path"), F.col("s.content").alias("content"), status.alias("status"))


def extraction_stats(rows: DataFrame) -> DataFrame:
    """A-G18: sources of each map by status."""
    return rows.groupBy("map_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("extracted", "skipped", "null_content")])


def offset_order(sections: DataFrame) -> DataFrame:
    """W-03: (map_id, i, verdict) of ``sections`` (map_id, i, line, column): whether an offset comes
    before or with the valid one in front of it."""
    before = Window.partitionBy("map_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when((F.col("line") >= 0) & (F.col("column") >= 0), F.struct("line", "column"))
    rows = sections.withColumn("prev", F.last(valid, ignorenulls=True).over(before)).withColumn("own", valid)
    return rows.select("map_id", "i", F.when(F.col("own").isNull(), "invalid").when(F.col("own") < F.col("prev"), "unordered").when(F.col("own") == F.col("prev"), "overlap").otherwise("ok").alias("verdict"))
