"""A run's state: a snapshot table and the log written since, loaded, resumed and compacted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.streaming import wal as W

SNAPSHOT = "phase STRING, status STRING, started_at STRING, completed_at STRING, error STRING, last_seq LONG"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def load_state(spark: SparkSession, state_path: str, log_path: str) -> tuple[DataFrame, DataFrame]:
    """S-21: (phases, events): the snapshot with the log's valid events applied, and those events.

    Events up to the first corrupt line count; ``corrupted`` tells of one. A phase that the log
    does not mention keeps what the snapshot says. A missing log is empty, a missing snapshot too.
    """
    empty = spark.createDataFrame([], SNAPSHOT)
    held = spark.read.schema(SNAPSHOT).json(state_path) if exists(spark, state_path) else empty
    lines = W.read_lines(spark, log_path) if exists(spark, log_path) else spark.createDataFrame([], "line_no int, text string")
    events = W.valid_prefix(lines)
    since = F.lit(held.agg(F.max("last_seq")).first()[0] or 0).cast("long")
    fresh = events.where(F.col("seq") > since)
    folded = W.fold_phases(fresh)
    seq = fresh.agg(F.max("seq").alias("to")).select(F.coalesce("to", since).alias("to"))
    both = held.alias("h").join(folded.alias("f"), F.col("h.phase") == F.col("f.phase"), "full_outer")
    # What a later event does not say stays: a phase that completes keeps when it started.
    kept = [F.coalesce(F.col(f"f.{c}"), F.col(f"h.{c}")).alias(c) for c in ("phase", "status", "started_at", "completed_at", "error")]
    return both.select(*kept).crossJoin(F.broadcast(seq)).withColumnRenamed("to", "last_seq"), events


def is_corrupted(events: DataFrame, lines: DataFrame) -> bool:
    """Whether a log has a line that is no valid event."""
    return events.count() < lines.count()


def compact(spark: SparkSession, state_path: str, log_path: str, at: str) -> int:
    """K-08: fold the log into the snapshot and begin a new log with one event that says so; the number of events folded.

    A corrupt log is refused. The new snapshot is written beside the old one and put in its place
    by a rename, so a run that dies in between finds one of both. An empty log changes nothing.
    """
    lines = W.read_lines(spark, log_path)
    phases, events = load_state(spark, state_path, log_path)
    if is_corrupted(events, lines):
        raise ValueError(f"{log_path} is corrupt; it cannot be compacted until that is resolved")
    n = events.count()
    if not n:
        return 0
    last = events.agg(F.max("seq")).first()[0]
    fresh, old = f"{state_path}.tmp", f"{state_path}.old"
    phases.coalesce(1).write.mode("overwrite").json(fresh)
    fs, target = _file_system(spark, state_path)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, path(old))
    fs.rename(path(fresh), target)
    fs.delete(path(old), True)
    append(spark, log_path, [{"seq": last + 1, "timestamp": at, "type": "wal:compacted"}], begin=True)
    return n


def append(spark: SparkSession, log_path: str, events: list[dict], begin: bool = False) -> None:
    """K-07: add events to a log file, or with ``begin`` start it anew; written through the log's own file system."""
    fs, target = _file_system(spark, log_path)
    text = "".join(json.dumps(e) + "\n" for e in events)
    before = "" if begin or not fs.exists(target) else "".join(r["value"] for r in spark.read.text(log_path, wholetext=True).collect())
    out = fs.create(target, True)
    out.write(bytearray((before + text).encode()))
    out.close()


def can_resume(spark: SparkSession, state_path: str, log_path: str) -> str:
    """G-06: resume, begin (there is nothing to resume) or repair (the log is corrupt)."""
    if not exists(spark, state_path) and not exists(spark, log_path):
        return "begin"
    if exists(spark, log_path):
        lines = W.read_lines(spark, log_path)
        if is_corrupted(W.valid_prefix(lines), lines):
            return "repair"
    return "resume"
