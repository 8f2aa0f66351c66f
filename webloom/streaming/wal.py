"""Event logs: reading, checking and folding them, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.tables import numbered

# The kinds of event.
EVENT_TYPES = (
    "phase:start", "phase:complete", "phase:fail", "scrape:result", "extract:bundle", "capture:page:started",
    "capture:page:completed", "capture:page:failed", "capture:urls:discovered", "rebuild:result", "wal:compacted",
)
SCHEMA = "seq LONG, timestamp STRING, type STRING, phase STRING, url STRING, bundleName STRING, filesWritten LONG, error STRING"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S-20: (line_no, text) of one JSON-lines log, blank lines left out.

    A log is ordered as a whole, so its lines are numbered where it is read: one file is one row.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "text")).select((F.col("pos") + 1).alias("line_no"), "text").where(F.trim("text") != "")


def valid_prefix(lines: DataFrame) -> DataFrame:
    """S-20, F-25: the events in front of the first line that is no valid event, with ``corrupted`` telling whether there is one."""
    e = lines.withColumn("e", F.from_json("text", SCHEMA))
    ok = F.coalesce(F.col("e.type").isin(*EVENT_TYPES) & F.col("e.timestamp").isNotNull() & F.col("e.seq").isNotNull(), F.lit(False))
    e = e.withColumn("ok", ok)
    bad = e.agg(F.min(F.when(~F.col("ok"), F.col("line_no"))).alias("bad_line"))
    return e.join(F.broadcast(bad)).where(F.col("bad_line").isNull() | (F.col("line_no") < F.col("bad_line"))).select("line_no", "e.*", F.col("bad_line").isNotNull().alias("corrupted"))


def first_gap(events: DataFrame, start: int = 0) -> DataFrame:
    """W-04: the first place (from 0) whose sequence number is not the next one."""
    return numbered(events, [F.col("line_no")], "i").where(F.col("seq") != start + 1 + F.col("i")).agg(F.min("i").cast("int").alias("gap"))


def fold_phases(events: DataFrame, last_seq: int = 0) -> DataFrame:
    """W-06, G-05: (phase, status, started_at, completed_at, error) after all events behind ``last_seq``."""
    p = events.where((F.col("seq") > last_seq) & F.col("type").isin("phase:start", "phase:complete", "phase:fail"))
    status = F.when(F.col("type") == "phase:start", "in_progress").when(F.col("type") == "phase:complete", "completed").otherwise("failed")
    at = lambda kind, c: F.max_by(F.when(F.col("type") == kind, F.col(c)), F.when(F.col("type") == kind, F.col("seq")))
    return p.groupBy("phase").agg(F.max_by(status, "seq").alias("status"), at("phase:start", "timestamp").alias("started_at"), at("phase:complete", "timestamp").alias("completed_at"), at("phase:fail", "error").alias("error"))


def fold_pages(events: DataFrame) -> DataFrame:
    """W-06, G-08: (url, status) of pages: the last thing said of each; failed pages are kept apart from pending ones."""
    p = events.where(F.col("type").startswith("capture:page:"))
    return p.groupBy("url").agg(F.max_by(F.regexp_replace("type", "^capture:page:", ""), "seq").alias("status"), F.bool_or(F.col("type") == "capture:page:completed").alias("completed"))


def fold_bundles(events: DataFrame) -> DataFrame:
    """W-06: (bundle, files): extracted bundles, the first record of each."""
    return events.where("type = 'extract:bundle'").groupBy(F.col("bundleName").alias("bundle")).agg(F.min_by("filesWritten", "seq").alias("files"))


def dedupe_stream(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """G-02: a stream's first event of each key within ``delay``; the state is bounded by the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, delay: str, length: str, key: str) -> DataFrame:
    """Counts by window and key of a stream, late events beyond ``delay`` left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """K-07: run a stream over what is there now into a table in memory, then stop."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
