"""Queries over the page, document and event tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import code as C
from webloom.functions import html as H
from webloom.functions import patterns as P
from webloom.functions import urls as U
from webloom.functions import paths as T
from webloom.operators import pages as O
from webloom.operators import relations as RL
from webloom.operators.tables import cut, numbered


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_links(spark, d):
    """P-17, C-12, C-13, F-02: same-origin links of every page."""
    return O.links(_t(spark, d, "pages").select("page_id", "url", "html"))


def url_normalize_dedupe(spark, d):
    """C-13, W-01: the first page of every normalised URL."""
    p = _t(spark, d, "pages").select("page_id", U.crawl_url(F.col("url")).alias("crawl_url"))
    return p.groupBy("crawl_url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


def url_pattern_groups(spark, d):
    """C-19, A-G03: requests by pattern."""
    r = O.with_pattern(O.request_paths(_t(spark, d, "pages").select("page_id", "url")))
    return r.groupBy("pattern", "priority").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.array_join(F.first("params"), ",").alias("params"))


def pattern_priority_rank(spark, d):
    """C-20, T-01: fixtures in the order of their own priority, one for each pattern."""
    r = O.with_pattern(O.request_paths(_t(spark, d, "pages").select("page_id", "url")))
    g = r.groupBy("pattern").agg(F.min("page_id").alias("ord")).withColumn("sort_priority", P.sort_priority(F.col("pattern")))
    ranked = numbered(g, [F.desc("sort_priority"), F.col("ord")], "rank")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))


def host_grouping_sets(spark, d):
    """A-G04: pages by host and by language folder, and in all."""
    p = _t(spark, d, "pages").select(U.host(F.col("url")).alias("host"), F.split_part("url", F.lit("/"), F.lit(4)).alias("folder"))
    return O.histogram(p, {"host": F.col("host"), "folder": F.col("folder")})


def html_metadata(spark, d):
    """P-19: title, language and further metas of every page."""
    return _t(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.language(F.col("html")).alias("lang"), F.size(H.metas(F.col("html"))).alias("n_metas"))


def ssr_test(spark, d):
    """F-14: which pages hold rendered text."""
    return _t(spark, d, "pages").select("page_id", H.server_rendered(F.col("html")).alias("server_rendered"), F.length(F.trim(H.body_without_scripts(F.col("html")))).alias("body_chars"))


def normalized_hash_dupes(spark, d):
    """C-29, W-01: texts that are equal but for white space."""
    docs = _t(spark, d, "documents").select("doc_id", C.normalized_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


def minified_heuristic(spark, d):
    """F-13: which texts look like minified code."""
    return _t(spark, d, "documents").select("doc_id", C.looks_minified(F.col("text")).alias("minified"))


def vendor_heuristic(spark, d):
    """F-12: which texts look like vendor bundles, named by their source."""
    return _t(spark, d, "documents").select("doc_id", C.looks_vendor(F.concat(F.col("source"), F.lit(".js")), F.col("text")).alias("vendor"))


def number_features(spark, d):
    """P-39: distinct numeric constants of every text."""
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(C.number_literals(F.col("text"))), ",").alias("numbers"))


def url_local_paths(spark, d):
    """C-16, C-17, C-18: where pages are kept, and their types, for one site's origin."""
    base = F.lit("https://m.ththea.example.org/")
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", U.local_path(u, base).alias("local_path"), U.content_type(F.lit(None).cast("string"), u).alias("content_type"), U.resource_type(u).alias("resource_type"))


def query_param_maps(spark, d):
    """C-24: parameters of every page's query."""
    return _t(spark, d, "pages").select("page_id", F.explode(U.query_params(F.col("url"))).alias("name", "value"))


def bundle_names(spark, d):
    """C-02, C-07, C-14, C-23: names derived from every page's path."""
    path = U.url_path(F.col("url"))
    return _t(spark, d, "pages").select("page_id", T.clean_filename(path).alias("file"), T.bundle_name(path).alias("bundle"), U.request_path(path).alias("request_path"), P.fixture_filename(F.lit("GET"), path).alias("fixture_file"))


def crawl_bfs(spark, d):
    """G-01, T-04: a crawl over a made-up graph of 97 nodes with cycles; ``crawl_pages`` follows real links."""
    e = _t(spark, d, "events").select("user_id", "event_id")
    nodes = e.select((F.col("user_id") % 97).alias("a"), ((F.col("user_id") * 7 + F.col("event_id") % 3) % 97).alias("b")).distinct()
    edges = nodes.select(F.concat(F.lit("/n/"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("/n/"), F.col("b").cast("string")).alias("dst"))
    return O.crawl(spark.createDataFrame([("/n/1",)], "url string"), edges, max_depth=5, max_pages=100, cut=cut)


def crawl_pages(spark, d):
    """G-01, T-04: a crawl from each origin's first page over the links of all pages."""
    p = _t(spark, d, "pages").select("page_id", "url", "html")
    named = p.select("page_id", U.origin(F.col("url")).alias("origin"), U.crawl_url(F.col("url")).alias("src"))
    edges = cut(O.links(p).join(named, "page_id").select("src", F.col("link").alias("dst")).distinct())
    seeds = named.groupBy("origin").agg(F.min_by("src", "page_id").alias("url")).select("url")
    return O.crawl(seeds, edges, max_depth=5, max_pages=1000, cut=cut)


def event_props(spark, d):
    """P-05, C-26: values out of event bodies; a body that is no JSON gives null."""
    v = F.try_parse_json(F.col("props"))
    return _t(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.schema_of_variant(v).alias("shape")).withColumn("shape", F.when(F.col("shape").startswith("OBJECT"), "object").otherwise("other"))


def latest_phase(spark, d):
    """W-06, G-08: the last event of every user, as phases are folded out of a log."""
    e = _t(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("phase"), F.max("event_id").alias("last_seq"), F.count("*").alias("n_events"))


def sequence_gaps(spark, d):
    """W-04: the first place in each user's log where event numbers jump by more than 300."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _t(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("before"))
    return e.where(F.col("event_id") - F.col("before") > 300).groupBy("user_id").agg(F.min("event_id").alias("first_gap"))


def request_response_pairs(spark, d):
    """J-22: every click with the first purchase of the same user after it, unless another click came first."""
    e = _t(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumns({"next_id": F.lead("event_id").over(w), "next_type": F.lead("event_type").over(w)})
    return e.where("event_type = 'click' and next_type = 'purchase'").select("user_id", F.col("event_id").alias("request_id"), F.col("next_id").alias("response_id"))


def keyed_dedupe(spark, d):
    """G-02, U-08: the first event of every (user, type), and how many were passed over."""
    e = _t(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), (F.count("*") - 1).alias("skipped"))


def capture_summary(spark, d):
    """A-G05, A-G06: counts and bytes of pages by content type's first part."""
    p = _t(spark, d, "pages").select(F.split_part(U.content_type(F.lit(None).cast("string"), F.col("url")), F.lit("/"), F.lit(1)).alias("kind"), F.octet_length("html").alias("bytes"))
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def relational_division(spark, d):
    """J-13: orders that hold both return flags R and A, and the number of their lines."""
    return RL.holding_all(_t(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", ["R", "A"])


def unique_source(spark, d):
    """J-14: customers whose orders all have one status, and that status."""
    return RL.only_value(_t(spark, d, "orders"), "o_custkey", "o_orderstatus", "status")


def dependency_usage(spark, d):
    """A-G01, A-G02: for every part kind, how many distinct orders use it, and the first one."""
    li = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    p = _t(spark, d, "part").select("p_partkey", "p_type")
    return RL.uses(li.join(p, li.l_partkey == p.p_partkey), "p_type", "l_orderkey")


def classify_customers(spark, d):
    """J-07: customers by whether they have orders: semi and anti classification in one join."""
    return RL.classified(_t(spark, d, "customer"), "c_custkey", _t(spark, d, "orders"), "o_custkey", "external", "internal")


def missing_files(spark, d):
    """J-10, U-08: customers without an urgent open order, by anti-join."""
    urgent = _t(spark, d, "orders").where("o_orderpriority like '1%' and o_orderstatus = 'O'").select("o_custkey")
    return RL.without(_t(spark, d, "customer").select("c_custkey"), "c_custkey", urgent, "o_custkey")


def version_statistics(spark, d):
    """A-G14: histograms of orders by status and by priority, and in all."""
    o = _t(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    return O.histogram(o, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


def top_five_versions(spark, d):
    """T-03: the five dearest orders of every customer."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.rank_latest(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def first_and_last(spark, d):
    """A-G15: the first and the last status of every customer's orders."""
    return RL.ends(_t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


def workspace_roots(spark, d):
    """A-G13, W-09: a folder for each user by the strongest kind of evidence that there is."""
    return RL.strongest(_t(spark, d, "events"), "user_id", {"purchase": 1, "signup": 2, "click": 3}, "event_type", "event_id", 4)


def running_sums(spark, d):
    """W-02, W-07: running sums over a user's log, with and without a reset at each event type, and a running index."""
    return RL.running(_t(spark, d, "events"), "user_id", "event_type", "event_id", F.floor("value").cast("long"))


def fixture_match(spark, d):
    """J-05, C-36, J-32: every request with its fixture; fixtures are the first page of each pattern."""
    r = O.with_pattern(O.request_paths(_t(spark, d, "pages").select("page_id", "url")))
    fixtures = r.groupBy("method", "pattern").agg(F.min("page_id").alias("fixture_id"), F.min_by("path", "page_id").alias("path")).withColumn("priority", P.sort_priority(F.col("pattern")))
    requests = r.select(F.col("page_id").alias("req_id"), "method", "path")
    return O.match_requests(requests, fixtures)


QUERIES = {f.__name__: f for f in (
    page_links, url_normalize_dedupe, url_pattern_groups, pattern_priority_rank, host_grouping_sets, html_metadata, ssr_test,
    normalized_hash_dupes, minified_heuristic, vendor_heuristic, number_features, url_local_paths, query_param_maps, bundle_names,
    crawl_bfs, crawl_pages, event_props, latest_phase, sequence_gaps, request_response_pairs, keyed_dedupe, capture_summary, relational_division,
    unique_source, dependency_usage, classify_customers, missing_files, version_statistics, top_five_versions, first_and_last,
    workspace_roots, running_sums, fixture_match,
)}

# What the SQL below shares: a page's parts, and its request path.
_P = r"""
p AS (SELECT page_id, url, html, regexp_extract(url, '^https?://[^/?#]*', 0) AS origin,
  regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS path,
  regexp_extract(url, '\?[^#]*') AS query FROM pages)"""
_REQ = _P + r""", q AS (SELECT page_id, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS path FROM p),
s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM q),
f AS (SELECT *, list_transform(seg, lambda x: regexp_matches(x, '^([0-9]+|[0-9a-fA-F]{24}|[a-zA-Z0-9]{6,12}|[A-Za-z0-9_-]{20,}|[0-9]{4}-[0-9]{2}-[0-9]{2})$')) AS dyn FROM s),
r AS (SELECT page_id, path, seg, dyn, '/' || array_to_string(list_transform(seg, lambda x, i: CASE WHEN dyn[i] THEN ':param' || len(list_filter(dyn[1:i-1], lambda b: b)) ELSE x END), '/') AS pattern,
  array_to_string(list_filter(list_transform(seg, lambda x, i: CASE WHEN dyn[i] THEN 'param' || len(list_filter(dyn[1:i-1], lambda b: b)) END), lambda x: x IS NOT NULL), ',') AS params,
  CAST(15 * len(seg) - 6 * len(list_filter(dyn, lambda b: b)) AS INTEGER) AS priority FROM f)"""
_ENC = r"""array_to_string(list_transform(string_split(X, ''), lambda c: CASE WHEN regexp_matches(c, '^[!$-;=@-_a-z|~]?$') THEN c ELSE url_encode(c) END), '')"""

ORACLE_SQL = {
    "page_links": f"""WITH {_P}, l AS (SELECT page_id, origin, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS h FROM p),
      n AS (SELECT page_id, origin || {_ENC.replace('X', "CASE WHEN length(h) > 1 THEN regexp_replace(h, '/$', '') ELSE h END")} AS link FROM l WHERE h LIKE '/%')
      SELECT DISTINCT page_id, link FROM n""",
    "url_normalize_dedupe": f"WITH {_P}, c AS (SELECT page_id, origin || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END || query AS crawl_url FROM p) SELECT crawl_url, min(page_id) AS first_page, count(*) AS n FROM c GROUP BY 1",
    "url_pattern_groups": f"WITH {_REQ} SELECT pattern, priority, count(*) AS n, min(path) AS first_path, min(params) AS params FROM r GROUP BY 1, 2",
    "pattern_priority_rank": f"WITH {_REQ}, g AS (SELECT pattern, min(page_id) AS ord FROM r GROUP BY 1), h AS (SELECT *, list_filter(string_split(pattern, '/'), lambda x: x <> '') AS seg FROM g), k AS (SELECT pattern, ord, CAST(15 * len(seg) - 4 * len(list_filter(seg, lambda x: x[1] = ':')) AS INTEGER) AS sort_priority FROM h) SELECT *, CAST(row_number() OVER (ORDER BY sort_priority DESC, ord) AS INTEGER) AS rank FROM k",
    "host_grouping_sets": f"WITH {_P}, x AS (SELECT host, split_part(url, '/', 4) AS folder FROM p) SELECT CASE WHEN grouping(host) = 0 THEN 'host' WHEN grouping(folder) = 0 THEN 'folder' ELSE 'total' END AS name, coalesce(host, folder) AS key, count(*) AS n FROM x GROUP BY GROUPING SETS ((host), (folder), ())",
    "html_metadata": r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
      CAST(len(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: NOT regexp_matches(lower(t), 'charset=|viewport|x-ua-compatible'))) AS INTEGER) AS n_metas FROM pages""",
    "ssr_test": r"""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), '(?is)<script\b[^>]*>.*?</script>', '', 'g')) AS body FROM pages)
      SELECT page_id, length(body) > 50 AS server_rendered, CAST(length(body) AS INTEGER) AS body_chars FROM b""",
    "normalized_hash_dupes": r"SELECT md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "minified_heuristic": r"""WITH m AS (SELECT doc_id, text, length(text) AS n, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS lines,
        len(regexp_extract_all(text, '[ \t\n\x0B\f\r]')) AS blanks, len(regexp_extract_all(text, '[(,]\s*[a-zA-Z]\s*[,)]')) AS short,
        len(regexp_extract_all(text, ';')) AS semis, regexp_matches(text[1:5000], '(?s)/\*.*?\*/|(?m://.*$)') AS comments FROM documents),
      k AS (SELECT *, n / greatest(lines, 1) AS mean, blanks / greatest(n, 1) AS ratio FROM m)
      SELECT doc_id, lines > 0 AND (mean > 200 OR ratio < 0.08 OR short / (greatest(n, 1) / 1000) > 3 OR (semis / greatest(lines, 1) > 8 AND NOT comments) OR (mean > 100 AND ratio < 0.15 AND NOT comments)) AS minified FROM k""",
    "vendor_heuristic": r"""SELECT doc_id, regexp_matches(lower(source) || '.js', 'vendor|chunk[-_]|^(lodash|react|vue|angular|jquery|moment|date-fns|axios|uuid)|^@|[-_][a-z0-9]{6,12}\.js$')
      OR (length(text) / len(string_split(text, chr(10))) > 500 AND len(string_split(text, chr(10))) < 50) AS vendor FROM documents""",
    "number_features": r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b([0-9]{3,}|[0-9]+\.[0-9]+)\b', 1), lambda x: x IS NOT NULL))), ','), '') AS numbers FROM documents",
    "url_local_paths": f"""WITH {_P} SELECT page_id, CASE WHEN origin = 'https://m.ththea.example.org' THEN regexp_replace(CASE WHEN path = '/' THEN '/index.html' WHEN position('.' IN path) = 0 THEN path || '/index.html' ELSE path END, '^/', '')
        ELSE '_external/' || md5(url)[1:12] || '_' || regexp_replace(CASE WHEN path LIKE '%/' THEN 'file' ELSE list_last(string_split(path, '/')) END, '[^a-zA-Z0-9._-]', '_', 'g') END AS local_path,
        CASE WHEN path LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END AS content_type, 'other' AS resource_type FROM p""",
    "query_param_maps": f"WITH {_P}, k AS (SELECT page_id, unnest(string_split(query[2:], '&')) AS kv FROM p WHERE query <> '') SELECT page_id, split_part(kv, '=', 1) AS name, split_part(kv, '=', 2) AS value FROM k",
    "bundle_names": f"""WITH {_P}, s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
      SELECT page_id, list_last(string_split(path, '/')) AS file, CASE WHEN len(seg) > 1 THEN seg[-2] || '/' || seg[-1] ELSE coalesce(seg[-1], 'bundle') END AS bundle,
        CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS request_path, 'GET_' || regexp_replace(replace(path[2:], '/', '_'), '[^a-zA-Z0-9_-]', '_', 'g') || '.json' AS fixture_file FROM s""",
    "crawl_bfs": """WITH RECURSIVE e AS (SELECT DISTINCT user_id % 97 AS a, (user_id * 7 + event_id % 3) % 97 AS b FROM events),
      w(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 5)
      SELECT '/n/' || node AS url, min(depth) AS depth FROM w GROUP BY node ORDER BY depth, url LIMIT 100""",
    "crawl_pages": f"""WITH RECURSIVE {_P}, l AS (SELECT page_id, origin, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS h FROM p),
      n AS (SELECT page_id, origin || {_ENC.replace('X', "CASE WHEN length(h) > 1 THEN regexp_replace(h, '/$', '') ELSE h END")} AS dst FROM l WHERE h LIKE '/%'),
      c AS (SELECT page_id, origin, origin || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END || query AS src FROM p),
      e AS (SELECT DISTINCT src, dst FROM n JOIN c USING (page_id)),
      w(url, depth) AS (SELECT DISTINCT min_by(src, page_id), 0 FROM c GROUP BY origin UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 5)
      SELECT url, min(depth) AS depth FROM w GROUP BY url ORDER BY depth, url LIMIT 1000""",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END AS shape FROM events",
    "latest_phase": "SELECT user_id, max_by(event_type, event_id) AS phase, max(event_id) AS last_seq, count(*) AS n_events FROM events GROUP BY 1",
    "sequence_gaps": "WITH l AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, min(event_id) AS first_gap FROM l WHERE event_id - b > 300 GROUP BY 1",
    "request_response_pairs": "WITH l AS (SELECT user_id, event_id, event_type, lead(event_id) OVER w AS n, lead(event_type) OVER w AS t FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id AS request_id, n AS response_id FROM l WHERE event_type = 'click' AND t = 'purchase'",
    "keyed_dedupe": "SELECT user_id, event_type, min(event_id) AS first_id, count(*) - 1 AS skipped FROM events GROUP BY 1, 2",
    "capture_summary": f"WITH {_P} SELECT CASE WHEN path LIKE '%.html' THEN 'text' ELSE 'application' END AS kind, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM p GROUP BY 1",
    "relational_division": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag END) = 2",
    "unique_source": "SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1",
    "dependency_usage": "SELECT p_type, count(DISTINCT l_orderkey) AS n_orders, min(l_orderkey) AS first_order FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "classify_customers": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'external' ELSE 'internal' END AS kind FROM customer",
    "missing_files": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%' AND o_orderstatus = 'O')",
    "version_statistics": "SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'total' END AS name, coalesce(o_orderstatus, o_orderpriority) AS key, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "top_five_versions": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT * FROM r WHERE rank <= 5",
    "first_and_last": "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS first, max_by(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1",
    "workspace_roots": "WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS tier FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, event_id) AS n FROM t) SELECT user_id, tier, event_id FROM r WHERE n = 1",
    "running_sums": "SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_log, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS ord FROM events",
    "fixture_match": f"""WITH {_REQ}, x AS (SELECT pattern, min(page_id) AS fixture_id, min_by(path, page_id) AS path FROM r GROUP BY 1),
      k AS (SELECT *, 15 * len(list_filter(string_split(pattern, '/'), lambda s: s <> '')) - 4 * len(list_filter(string_split(pattern, '/'), lambda s: s[1] = ':')) AS priority,
        '^' || regexp_replace(regexp_replace(pattern, '([.+*?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), ':[A-Za-z0-9_]+', '([^/]+)', 'g') || '$' AS re FROM x),
      c AS (SELECT r.page_id AS req_id, k.fixture_id, CASE WHEN r.path = k.path THEN 'exact' ELSE 'pattern' END AS kind, row_number() OVER (PARTITION BY r.page_id ORDER BY r.path = k.path DESC, k.priority DESC, k.fixture_id) AS n FROM r JOIN k ON r.path = k.path OR regexp_matches(r.path, k.re))
      SELECT req_id, fixture_id, kind FROM c WHERE n = 1""",
}
