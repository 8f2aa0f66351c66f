"""The crawl of the page table's links against brute force, where pages link to each other."""

from __future__ import annotations

from webloom.operators import pages as O
from webloom.operators.tables import cut
from webloom.plans import pages


def test_crawl_follows_the_links_of_all_pages(spark, tmp_path):
    n = 60
    to = {i: [(7 * i + 2) % n, (i * i + 4) % n, n + i] for i in range(n)}
    rows = [(i, f"https://{'ab'[i % 2]}.io/p{i}", "".join(f'<a href="/p{j}">x</a>' for j in js)) for i, js in to.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    links = {url: [f"{url[:12]}/p{j}" for j in to[i]] for i, url, _ in rows}
    depth, frontier = {}, ["https://a.io/p0", "https://b.io/p1"]
    for k in range(6):
        depth |= {u: k for u in frontier}
        frontier = {v for u in frontier for v in links.get(u, []) if v not in depth}
    assert {r["url"]: r["depth"] for r in pages.crawl_pages(spark, str(tmp_path)).collect()} == depth and max(depth.values()) > 1
    edges = spark.createDataFrame([(u, v) for u, vs in links.items() for v in vs], "src string, dst string")
    capped = O.crawl(spark.createDataFrame([("https://a.io/p0",), ("https://b.io/p1",)], "url string"), edges, 5, 5, cut)
    assert [(r["url"], r["depth"]) for r in capped.collect()] == sorted(depth.items(), key=lambda x: (x[1], x[0]))[:5]
