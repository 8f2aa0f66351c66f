"""Relational operators that several analyses share: classification, division, tiers, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def holding_all(rows: DataFrame, key: str, value: str, need: list) -> DataFrame:
    """J-13: (key, n): the keys that hold all values of ``need``, and the number of their rows; one aggregation."""
    held = F.count_distinct(F.when(F.col(value).isin(need), F.col(value)))
    return rows.groupBy(key).agg(held.alias("held"), F.count("*").alias("n")).where(F.col("held") == len(set(need))).select(key, "n")


def only_value(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """J-14: the keys whose rows all have one value, and that value as ``name``."""
    ends = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.where("low = high").select(key, F.col("low").alias(name))


def classified(rows: DataFrame, key: str, known: DataFrame, its_key: str, yes: str, no: str) -> DataFrame:
    """J-07: (key, kind): ``yes`` for keys that ``known`` has, else ``no``; semi and anti join in one."""
    hits = known.select(F.col(its_key).alias(key)).distinct().withColumn("hit", F.lit(True))
    return rows.select(key).join(hits, key, "left").select(key, F.when(F.col("hit"), yes).otherwise(no).alias("kind"))


def without(rows: DataFrame, key: str, other: DataFrame, its_key: str) -> DataFrame:
    """J-10, U-08: the rows whose key ``other`` lacks."""
    return rows.join(other, rows[key] == other[its_key], "left_anti")


def uses(rows: DataFrame, kind: str, user: str) -> DataFrame:
    """A-G01, A-G02: of each kind, how many different users have it, and the first of them."""
    return rows.groupBy(kind).agg(F.count_distinct(user).alias("n_orders"), F.min(user).alias("first_order"))


def ends(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A-G15: the first and the last value of each key by ``order``; one row a task and key is shuffled."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def strongest(rows: DataFrame, key: str, tiers: dict[str, int], kind: str, order: str, weakest: int) -> DataFrame:
    """A-G13, W-09: of each key the first row, by ``order``, of its strongest kind of evidence."""
    tier = F.lit(weakest)
    for name, rank in tiers.items():
        tier = F.when(F.col(kind) == name, rank).otherwise(tier)
    ranked = rows.select(key, order, tier.alias("tier"))
    return ranked.groupBy(key).agg(F.min("tier").alias("tier"), F.min_by(order, F.struct("tier", order)).alias(order))


def running(rows: DataFrame, key: str, reset: str, order: str, value: Column) -> DataFrame:
    """W-02, W-07: sums of ``value`` up to each row of a key, the same since the start of its ``reset`` group, and a running index."""
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    index = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    held = rows.select(key, order, reset, value.alias("q"))
    return held.select(order, F.sum("q").over(upto(key)).alias("in_log"), F.sum("q").over(upto(key, reset)).alias("in_type"), index.alias("ord"))
