"""Helpers shared by the training-data operators: tables, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) is a temporary folder used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="webloom-")
    return made


def _remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system; a session that has ended keeps it."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM is gone
        pass


#: Written tables that are still there, by path.
_written: dict[str, SparkSession] = {}


@atexit.register
def _remove_rest() -> None:
    for path, spark in _written.items():
        _remove(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the duration of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str = "t", compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in folders by the few values of ``by`` if that is named.

    This cuts the lineage: a lost executor costs at most the tasks since the last such
    table, and each plan stays small in loops. The write's shuffle files go when it is done,
    as nothing reads them again; the table goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "16"}):
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.webloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once whatever reads them has been written itself."""
    for t in tables:
        path = t.__dict__.get("webloom_path")
        if path in _written:
            _remove(_written.pop(path), path)


def release(spark: SparkSession) -> None:
    """Let the driver drop the plans, broadcasts and shuffle files that nothing needs any more: they wait for its garbage
    collections, and a long job of many short plans would fill its heap first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none is a column of ``df``, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v), u larger than v, are stars: one edge for each u, and no v that is a u."""
    if not e.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the component's
    id being its smallest node. Nodes without an edge are not returned.

    Alternating large-star and small-star rounds: each round hangs every node on the
    smallest neighbour it knows, so the rounds needed grow with the logarithm of the
    largest component. The rounds end when every edge leads from a node with no other edge
    to the smallest node of its component; nothing comes to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        # Large star: each node's larger neighbours hang on its smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p")
        ).select("p.u", "p.v").where("u <> v").distinct()
        last, e = e, stored(small, "edges")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    lows = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(lows)
    out.webloom_path = e.webloom_path  # ``discard`` it when it has been read
    return out
