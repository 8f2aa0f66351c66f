"""Operators on the page table (page_id, url, html): links, patterns, crawls, fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import html as H
from webloom.functions import patterns as P
from webloom.functions import urls as U


def _own_links(pages: DataFrame) -> DataFrame:
    """(page_id, own): the links of each page to its own origin, each once, in order. A page's own address is
    taken apart once, not for each link."""
    parts = U.base_parts(F.col("url"))
    rows = pages.select("page_id", "url", H.hrefs(F.col("html")).alias("refs"), *[c.alias(f"base_{k}") for k, c in parts.items()])
    known = {k: F.col(f"base_{k}") for k in parts}
    found = rows.select("page_id", "base_origin", F.transform("refs", lambda h: U.resolve(F.col("url"), h, known)).alias("found"))
    own = F.filter("found", lambda u: (U.origin(u) == F.col("base_origin")) & ~U.skipped(u))
    return found.select("page_id", F.array_distinct(F.transform(own, U.crawl_url)).alias("own"))


def links(pages: DataFrame) -> DataFrame:
    """P-17: (page_id, link), each link of a page to its own origin once. No shuffle: links are
    made distinct within the page's array before they are spread."""
    return _own_links(pages).select("page_id", F.explode("own").alias("link"))


def request_paths(pages: DataFrame) -> DataFrame:
    """(page_id, method, path): the pages' paths as requests."""
    return pages.select("page_id", F.lit("GET").alias("method"), F.regexp_replace(U.url_path(F.col("url")), r"(.)/$", "$1").alias("path"))


def with_pattern(requests: DataFrame) -> DataFrame:
    """C-19: requests with pattern, params and priority."""
    return requests.withColumn("p", P.url_pattern(F.col("path"))).select("*", "p.*").drop("p")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-01: the first row of each key by ``order``.

    ``min_by`` over a struct combines on the map side, so a hot key costs one row a task, where
    a window would sort all of its rows in one.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*rows.columns)


def url_map(assets: DataFrame, base: Column) -> DataFrame:
    """P-20: (key, local_path): full URLs, the last asset winning, and same-origin path and query, the first winning."""
    full = assets.groupBy(F.col("url").alias("key")).agg(F.max_by("local_path", "ord").alias("local_path"))
    own = assets.where(U.origin(F.col("url")) == U.origin(base))
    short = own.groupBy(F.concat(U.url_path(F.col("url")), U.query(F.col("url"))).alias("key")).agg(F.min_by("local_path", "ord").alias("local_path"))
    return full.unionByName(short.join(full, "key", "left_anti"))


def match_requests(requests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """J-05: each request (req_id, method, path) with its fixture (fixture_id, method, path, pattern,
    priority): the exact path first, else the fixture of highest priority whose pattern matches.

    An equi-join finds exact paths. For what is left, a pattern's mask tells which of its parts are
    parameters; a request's path is masked by each mask that patterns of its method and length
    have, and joined on what remains: the regular expression, which decides, sees only pairs that
    agree in all fixed parts.
    """
    parts = F.split(F.col("pattern"), "/")
    free = F.transform(parts, lambda s: s.rlike(":[A-Za-z0-9_]"))
    masked = lambda xs, m: F.array_join(F.zip_with(xs, m, lambda s, f: F.when(f, "*").otherwise(s)), "/")
    fx = fixtures.withColumns({"mask": free, "fixed": masked(parts, free), "regex": P.request_regex(F.col("pattern"))})
    rq = requests.withColumns({"path": U.request_path(F.col("path"))})
    exact = rq.alias("r").join(fx.alias("f"), (F.col("r.method") == F.col("f.method")) & (F.col("r.path") == F.col("f.path")))
    exact = exact.groupBy("req_id").agg(F.min_by("fixture_id", F.struct(-F.col("priority"), F.col("fixture_id"))).alias("fixture_id")).withColumn("kind", F.lit("exact"))
    rest = rq.join(exact, "req_id", "left_anti")
    masks = fx.select("method", "mask", F.size("mask").alias("n_parts")).distinct()
    seen = rest.withColumn("n_parts", F.size(F.split("path", "/"))).join(masks, ["method", "n_parts"])
    seen = seen.select("req_id", "method", "path", "mask", masked(F.split("path", "/"), F.col("mask")).alias("fixed"))
    loose = seen.alias("r").join(fx.alias("f"), (F.col("r.method") == F.col("f.method")) & (F.col("r.fixed") == F.col("f.fixed")) & (F.col("r.mask") == F.col("f.mask")) & F.expr("r.path rlike f.regex"))
    loose = loose.groupBy("req_id").agg(F.min_by("fixture_id", F.struct(-F.col("priority"), F.col("fixture_id"))).alias("fixture_id")).withColumn("kind", F.lit("pattern"))
    return exact.unionByName(loose)


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int, cut) -> DataFrame:
    """G-01: (url, depth) of a breadth-first crawl over ``edges`` (src, dst), at most ``max_pages``
    pages, ordered by depth, then URL. ``cut`` writes a table and reads it back, to keep lineage short.

    One join and one anti-join for each depth; URLs never come to the driver, counts do.
    """
    seen = cut(seeds.select("url", F.lit(0).alias("depth")).distinct())
    frontier, n = seen, seen.count()
    for depth in range(1, max_depth + 1):
        if n >= max_pages:
            break
        fresh = frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(depth)))
        found = frontier.count()
        if not found:
            break
        n += found
        seen = cut(seen.unionByName(frontier))
    return seen.orderBy("depth", "url").limit(max_pages)


def ordered_links(pages: DataFrame) -> DataFrame:
    """P-17: ``links`` with pos, a link's place among its page's links."""
    return _own_links(pages).select("page_id", F.posexplode("own").alias("pos", "link"))


def crawl_in_order(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int, cut) -> DataFrame:
    """G-01, T-04: (url, depth, key) of a crawl that takes pages first in, first out, over ``edges`` (src, dst, pos),
    from ``seeds`` (url, pos); at most ``max_pages`` pages in the order they are met.

    A page's key is its seed's place followed by the places of the links that led to it, so pages of a
    depth sort by their parents' order, then by place, without a sort of all rows. Of several
    ways to a page the first counts. One join and one anti-join for each depth; only counts reach the driver.
    """
    seen = cut(seeds.groupBy("url").agg(F.min("pos").alias("pos")).select("url", F.lit(0).alias("depth"), F.array("pos").alias("key")))
    frontier, n = seen, seen.count()
    for depth in range(1, max_depth + 1):
        if n >= max_pages:
            break
        met = frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url"), F.concat("key", F.array("pos")).alias("key"))
        frontier = cut(met.groupBy("url").agg(F.min("key").alias("key")).join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth"), "key"))
        found = frontier.count()
        if not found:
            break
        n += found
        seen = cut(seen.unionByName(frontier))
    return seen.orderBy("depth", "key").limit(max_pages)


def histogram(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """A-G04, A-G06: (name, key, n): a histogram for each of several keys and the total, in one pass."""
    spread = F.explode(F.array(F.struct(F.lit("total").alias("name"), F.lit(None).cast("string").alias("key")), *[F.struct(F.lit(k).alias("name"), c.cast("string").alias("key")) for k, c in keys.items()]))
    return rows.select(spread.alias("h")).groupBy("h.name", "h.key").agg(F.count("*").alias("n"))


def rank_latest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """T-03: the best ``n`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
