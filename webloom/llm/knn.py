"""Exact top-k inner products with vector-approximation files.

Every component is quantised to one of ``2**bits`` cells between its least and greatest
value in the table, and the cells' numbers are written once, a byte a component, beside the
exact vectors. A block of queries scans the cells first: one single-precision matrix product
bounds each score from above. Exact vectors are then read in the order of their bounds until
no bound can reach the kth score found so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import discard, stored

BITS = 6
#: Queries in a block: what is broadcast is at most so many vectors.
BLOCK = 2048
#: Components must be smaller, so that sums of products are exact in doubles.
LARGEST = 1 << 26


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows with ``q``: floor(scale * x) of each component x as double, as an array of long.

    Null vectors, empty ones and those that hold a null, a NaN or an infinity are left out.
    """
    x = F.col(vector).cast("array<double>")
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.where(ok).withColumn("q", F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class Cells:
    """Equal steps between each component's least and greatest value, for vectors of one length."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int) -> None:
        self.low = low.astype(np.float64)
        self.step = np.maximum(1.0, np.ceil((high - low + 1) / (1 << bits)))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.step).astype(np.uint8)

    def prepared(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``upper`` needs of queries: their products with a cell's step, and each one's constant.

        A cell's corner is at most step - 1 above its floor where a query's component is positive; the
        constant holds that, the product with the least values, and the error of single precision.
        """
        scaled = queries * self.step
        error = len(self.low) * 2.0**-22 * (np.abs(scaled) @ np.full(len(self.low), 256.0)) + 1
        return scaled.astype(np.float32), queries @ self.low + np.maximum(queries, 0) @ (self.step - 1) + error


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, cells: Cells) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scaled, self.constant = cells.prepared(vectors)
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-score, id), ascending

    def add(self, ids: np.ndarray, codes: np.ndarray, exact, read: int = 64) -> None:
        """Take a batch of candidates into account; ``exact`` reads the vectors at given places of it."""
        bounds = self.scaled @ codes.astype(np.float32).T
        for i, query in enumerate(self.ids):
            found = self.found[i]
            least = -found[-1][0] - self.constant[i] if len(found) == self.k else -np.inf
            live = np.flatnonzero((bounds[i] >= least) & (ids != query))
            live = live[np.argsort(-bounds[i, live], kind="stable")]
            for at in range(0, len(live), read):
                part = live[at : at + read]
                if len(found) == self.k and bounds[i, part[0]] + self.constant[i] < -found[-1][0]:
                    break  # no vector left can reach the kth score
                scores = exact(part) @ self.vectors[i]
                if len(found) == self.k:
                    keep = scores >= -found[-1][0]
                    part, scores = part[keep], scores[keep]
                order = np.lexsort((ids[part], -scores))[: self.k]
                found = sorted([*found, *((-float(scores[j]), int(ids[part[j]])) for j in order)])[: self.k]
            self.found[i] = found


def approximations(vectors: DataFrame, bits: int = BITS) -> tuple[DataFrame, dict[int, Cells]]:
    """The written table (vec_id, size, codes, exact) of ``vectors`` (vec_id, q), and the cells by vector length.

    Lengths, each with a least and a greatest value of every component, are all that reaches the driver.
    """

    def ranges(batches):
        for batch in batches:
            for size, rows in batch.groupby(batch["q"].map(len))["q"]:
                own = np.stack(rows.to_numpy())
                yield pd.DataFrame({"size": size, "at": np.arange(size), "low": own.min(axis=0), "high": own.max(axis=0)})

    seen = vectors.select("q").mapInPandas(ranges, "size int, at int, low long, high long").groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found: dict[int, list] = {}
    for r in seen.orderBy("size", "at").collect():
        if max(-r["low"], r["high"]) >= LARGEST:
            raise ValueError(f"a component of {LARGEST} or more: sums of products are not exact")
        found.setdefault(r["size"], []).append((r["low"], r["high"]))
    cells = {size: Cells(*np.array(own).T, bits) for size, own in found.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(cells)

    def code(batches):
        for batch in batches:
            for size, rows in batch.groupby(batch["q"].map(len)):
                own = np.stack(rows["q"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"vec_id": rows["vec_id"], "size": size, "codes": [x.tobytes() for x in sent.value[size].codes(own)], "exact": [x.tobytes() for x in own]})

    return stored(vectors.mapInPandas(code, "vec_id long, size int, codes binary, exact binary"), "cells", "snappy"), cells


def _search(queries, cells, k: int):
    """The function for mapInPandas: the k best of a task's candidates for each query."""

    def run(batches):
        best = {size: Best(ids, vectors, k, cells.value[size]) for size, (ids, vectors) in queries.value.items()}
        for batch in batches:
            for size, rows in batch.groupby("size"):
                if size in best:
                    codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), size)
                    held = rows["exact"].to_numpy()
                    read = lambda part, held=held, size=size: np.frombuffer(b"".join(held[part]), dtype=np.int64).reshape(len(part), size).astype(np.float64)
                    best[size].add(rows["vec_id"].to_numpy(), codes, read)
        out = [(int(q), i, int(-s)) for own in best.values() for q, found in zip(own.ids, own.found, strict=True) for s, i in found]
        if out:
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank (from 1), vec_id, score, as a written table.

    ``vectors``: vec_id, q (see ``quantised``). Queries are the rows for which the column
    ``is_query`` holds, of repeated rows of a vec_id the one with the least vector; candidates are
    all rows with another vec_id and as many components, repeated ones too. The score is the inner
    product; ties go to the smaller vec_id, fewer candidates than k give them all, and a query
    without a candidate gives no row. Null ids take no part; an empty table gives no row.
    Components must be under ``LARGEST``, else an error says so; ``bits`` is 8 at most.

    Queries are taken ``block`` rows at a time, in the order of their ids: each block is
    broadcast, scans the cells in a job of its own, and every task keeps k rows a query, so the
    driver, the tasks and the plan hold a fixed amount whatever the table's size.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id is not null")
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    table, cells = approximations(vectors.select("vec_id", "q"), bits)
    sent_cells = spark.sparkContext.broadcast(cells)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    after, parts = None, []
    while True:
        rows = (queries if after is None else queries.where(F.col("vec_id") > after)).orderBy("vec_id").limit(block).collect()
        if not rows:
            break
        after = rows[-1]["vec_id"]
        sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r["q"]) for r in rows}:
            own = [r for r in rows if len(r["q"]) == size]
            sizes[size] = (np.array([r["vec_id"] for r in own]), np.array([r["q"] for r in own], dtype=np.float64))
        sent = spark.sparkContext.broadcast(sizes)
        found = table.mapInPandas(_search(sent, sent_cells, k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(stored(found.select("query_id", "rank", "vec_id", "score"), "nearest"))
        sent.destroy()
        if len(rows) < block:
            break
    discard(table)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(parts[0].schema).parquet(*[p.webloom_path for p in parts])


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every row whose vec_id is divisible by 50."""
    from webloom.llm.common import table

    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows, F.col("vec_id") % 50 == 0, k=5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
