"""Lineage cuts for iterative operators outside the llm subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder's path below the one named in spark.checkpoint.dir (a temporary one in local sessions)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/webloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends; a session that has ended before keeps it."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM is gone
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write to a new folder and read back."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, in ``order``, which must tell all rows apart.

    Rows are sorted by ranges and written; a row's place is its place in its range and the sizes
    of the ranges before, of which one number each reaches the driver. No task sees all rows.
    """
    place, part = f"{name}_in_part", f"{name}_part"
    low = F.lit((1 << 33) - 1)  # a running number has the partition above these bits
    rows = df.orderBy(*order).withColumn(place, F.monotonically_increasing_id())
    rows = cut(rows.withColumns({part: F.shiftright(place, 33).cast("int"), place: F.col(place).bitwiseAND(low)}))
    sizes = {r[part]: r["count"] for r in rows.groupBy(part).count().collect()}
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate([0, *(sizes[p] for p in parts)]), strict=False))
    starts = df.sparkSession.createDataFrame(list(before.items()), f"{part} int, {name}_start long")
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(f"{name}_start") + F.col(place)).drop(part, place, f"{name}_start")
