"""Operators on rebuilt projects, queues and caches: assets, aliases, versions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asset_mapping(bundles: DataFrame, assets: DataFrame) -> DataFrame:
    """J-30: (path, type, rebuilt) of ``bundles`` (path, type): each on the one rebuilt entry of its type among ``assets`` (name).

    The entry is the first file by name that begins with index- and ends like the type; a type
    without one maps nothing. One row for each type is joined, whatever the assets' number.
    """
    kind = F.when(F.col("name").endswith(".js"), "script").when(F.col("name").endswith(".css"), "stylesheet")
    entries = assets.where(F.col("name").startswith("index-")).groupBy(kind.alias("type")).agg(F.min("name").alias("name")).where("type is not null")
    return bundles.join(F.broadcast(entries), "type").select("path", "type", F.concat(F.lit("/assets/"), F.col("name")).alias("rebuilt")).distinct()


def by_specificity(aliases: DataFrame) -> DataFrame:
    """T-05: aliases (alias, path), those with more parts first, then longer ones, then by name."""
    return aliases.orderBy(F.desc(F.size(F.split("alias", "/"))), F.desc(F.length("alias")), "alias")


def by_confidence(entries: DataFrame) -> DataFrame:
    """T-07: entries (path, confidence, ord), the surest first, equals in their order."""
    return entries.orderBy(F.desc("confidence"), "ord")


def fixed_versions(dependencies: DataFrame, public: DataFrame) -> DataFrame:
    """J-28: ``dependencies`` (name, version) with unknown versions fixed: latest for ``public`` packages (name), else internal.

    Adds outcome: kept, fixed or internal. A semi-join on a broadcastable list of names or a shuffle, as Spark finds.
    """
    known = public.select("name").distinct().withColumn("found", F.lit(True))
    rows = dependencies.join(known, "name", "left")
    unknown = F.col("version") == "*"
    outcome = F.when(~unknown, "kept").when(F.col("found"), "fixed").otherwise("internal")
    version = F.when(~unknown, F.col("version")).when(F.col("found"), "latest").otherwise("workspace:*")
    return rows.select("name", version.alias("version"), outcome.alias("outcome"))


def fixture_groups(requests: DataFrame) -> DataFrame:
    """A-G17: (key, n, first) of ``requests`` (id, method, pattern) by method and pattern."""
    return requests.groupBy(F.concat_ws(" ", "method", "pattern").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def queue_stats(items: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """A-G19: one row of statistics over ``items`` (url, depth, status) that a crawl has met.

    Links that lie deeper than ``max_depth`` are skipped and not discovered; status is queued,
    in_progress, completed or skipped (given up after its retries).
    """
    deep = F.col("depth") > max_depth
    done = F.count_if(F.col("status") == "completed")
    return items.agg(
        done.alias("visited"), F.count_if(deep | (F.col("status") == "skipped")).alias("skipped"), F.count_if(~deep).alias("discovered"),
        F.coalesce(F.bool_or(deep), F.lit(False)).alias("max_depth_reached"), (F.count_if(F.col("status").isin("completed", "in_progress")) >= max_pages).alias("max_pages_reached"),
    )


def cache_stats(entries: DataFrame) -> DataFrame:
    """A-G20: (kind, n, chars) of cache ``entries`` (kind, body)."""
    return entries.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))


def missing_dependencies(imported: DataFrame, declared: DataFrame) -> DataFrame:
    """A-G21: the names of ``imported`` (name) that ``declared`` (name) lacks, each once."""
    return imported.select("name").distinct().join(declared.select("name"), "name", "left_anti")


def retried(items: DataFrame, max_retries: int, base_ms: int = 500, most_ms: int = 5000) -> DataFrame:
    """G-03, G-04: failed ``items`` (url, retries) as they go on: queued again after a wait, or visited and skipped."""
    again = F.col("retries") < max_retries
    wait = F.least(F.lit(base_ms) * F.pow(F.lit(2), F.col("retries")), F.lit(most_ms)).cast("long")
    return items.select("url", F.when(again, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"), F.when(again, "queued").otherwise("skipped").alias("status"), F.when(again, wait).alias("wait_ms"))
