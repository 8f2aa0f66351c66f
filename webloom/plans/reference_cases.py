"""Queries over small fixed tables for validation, predicates and rebuilt projects, and over pages for crawls and files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from webloom.functions import declarations as D
from webloom.functions import mapcheck as MC
from webloom.functions import patterns as P
from webloom.functions import predicates as R
from webloom.functions import scanners as SC
from webloom.functions import signals as S
from webloom.functions import urls as U
from webloom.operators import packages as K
from webloom.operators import pages as O
from webloom.operators import rebuild as B
from webloom.operators.tables import cut
from webloom.plans import pages as PG
from webloom.plans.cases import ORACLE_SQL as _SQL
from webloom.plans.cases import QUERIES as _QUERIES
from webloom.plans.cases import _case, _pairs, _texts
from webloom.sources import files as FS

_before = set(_QUERIES)

# Maps: P-05 to P-09.
_MAP = {"version": 3, "sources": ["index.ts"], "mappings": "AAAA"}


def _section(line=0, column=0, **more):
    return {"offset": {"line": line, "column": column}, "map": _MAP, **more}


def _without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def _faults(c):
    return F.array_join(F.transform(MC.map_faults(c), lambda x: F.concat_ws("@", x["code"], x["field"])), ",")


_OFF, _ORDER, _SECTIONS, _INNER = "INVALID_INDEX_MAP_OFFSET", "INDEX_MAP_INVALID_ORDER", "INVALID_INDEX_MAP_SECTIONS", "INVALID_INDEX_MAP_SECTION_MAP"
_texts("p06_map_faults", _faults, [(json.dumps(m) if not isinstance(m, str) else m, r) for m, r in [
    (_MAP, ""), ({"version": 2, "sources": [], "mappings": ""}, "INVALID_VERSION@version"), ({"version": "3", "sources": [], "mappings": ""}, "INVALID_VERSION@version"),
    ({}, "MISSING_VERSION@version,MISSING_SOURCES@sources,MISSING_MAPPINGS@mappings"), ({**_MAP, "sources": "a"}, "SOURCES_NOT_ARRAY@sources"), ({**_MAP, "sources": ["a", None]}, ""),
    ({**_MAP, "sources": [1]}, "SOURCES_NOT_ARRAY@sources"), ({**_MAP, "mappings": 5}, "MISSING_MAPPINGS@mappings"), ({**_MAP, "sourcesContent": [None]}, ""), ({**_MAP, "sourcesContent": [1]}, "INVALID_SOURCES_CONTENT@sourcesContent"),
    ({**_MAP, "names": [1]}, "INVALID_NAMES@names"), ({**_MAP, "sourceRoot": None}, "INVALID_SOURCE_ROOT@sourceRoot"), ({**_MAP, "file": 1}, "INVALID_FILE@file"), ({**_MAP, "ignoreList": [0]}, ""),
    ({**_MAP, "ignoreList": [1]}, "INVALID_IGNORE_LIST@ignoreList"), ({**_MAP, "ignoreList": [-1]}, "INVALID_IGNORE_LIST@ignoreList"), ({**_MAP, "mappings": "AAAA,"}, "INVALID_MAPPING_SEGMENT@mappings"), ({**_MAP, "mappings": ";;AAAA;"}, ""),
    ({**_MAP, "mappings": "AA"}, "INVALID_MAPPING_SEGMENT@mappings"), ({**_MAP, "mappings": "!AAA;AA"}, "INVALID_VLQ@mappings"), ({**_MAP, "mappings": "g;AA"}, "INVALID_VLQ@mappings,INVALID_MAPPING_SEGMENT@mappings"),
    ({**_MAP, "mappings": "D"}, "MAPPING_NEGATIVE_VALUE@mappings"), ({**_MAP, "mappings": "ACAA"}, "MAPPING_SOURCE_INDEX_OUT_OF_BOUNDS@mappings"), ({**_MAP, "mappings": "AAAAA"}, "MAPPING_NAME_INDEX_OUT_OF_BOUNDS@mappings"), ("[1]", "INVALID_JSON@"), ("{", "INVALID_JSON@"),
]])
_texts("p08_index_map_faults", _faults, [(json.dumps({"version": 3, **m}), r) for m, r in [
    ({"sections": []}, ""), ({"sections": [_section()], "sources": ["index.ts"]}, ""), ({"sections": [_section(0, 0), _section(1, 0), _section(2, 0)]}, ""), ({"sections": [_section(0, 0), _section(0, 10)], "file": "b.js"}, ""),
    ({"sections": "no"}, f"{_SECTIONS}@sections"), ({"sections": None}, f"{_SECTIONS}@sections"), ({"sections": ["x", None, 1]}, ",".join(f"{_SECTIONS}@sections[{i}]" for i in range(3))),
    ({"sections": [{"map": _MAP}]}, f"{_OFF}@sections[0].offset"), ({"sections": [{"offset": "x", "map": _MAP}]}, f"{_OFF}@sections[0].offset"), ({"sections": [{"offset": None, "map": _MAP}]}, f"{_OFF}@sections[0].offset"),
    ({"sections": [{"offset": {"column": 0}, "map": _MAP}]}, f"{_OFF}@sections[0].offset.line"), ({"sections": [{"offset": {"line": 0}, "map": _MAP}]}, f"{_OFF}@sections[0].offset.column"),
    ({"sections": [_section(-1, 1.5)]}, f"{_OFF}@sections[0].offset.line,{_OFF}@sections[0].offset.column"), ({"sections": [_section(1, 0), _section(0, 0)]}, f"{_ORDER}@sections[1].offset"), ({"sections": [_section(0, 5), _section(0, 2)]}, f"{_ORDER}@sections[1].offset"),
    ({"sections": [_section(), _section()]}, "INDEX_MAP_OVERLAP@sections[1].offset"), ({"sections": [_without(_section(), "map")]}, f"{_INNER}@sections[0].map"), ({"sections": [{**_section(), "map": "x"}]}, f"{_INNER}@sections[0].map"),
    ({"sections": [{**_section(), "map": {"version": 3, "sections": []}}]}, "INDEX_MAP_NESTED@sections[0].map"), ({"sections": [{**_section(), "map": _without(_MAP, "version")}]}, "MISSING_VERSION@sections[0].map.version"),
    ({"sections": [_section()], "mappings": "AAAA"}, "INDEX_MAP_WITH_MAPPINGS@mappings"), ({"sections": [], "file": 1, "version": 2}, "INVALID_VERSION@version,INVALID_FILE@file"),
]])

# Code and errors: F-15, F-20, P-24, P-47.
_RENDER = "render(<App/>, document.getElementById('root'))"
_texts("f15_mounts", S.has_render_call, [("mount(App, { target: document.getElementById('app') })", True), (_RENDER, True), ("hydrate(<App/>, document.getElementById('x'))", True), ("new App({ target: document.getElementById('app') })", True), ("mount(App)", False)], "BOOLEAN")
_texts("p47_file_framework", S.file_framework, [(_RENDER, "react"), ("import { h } from 'preact'; " + _RENDER, "preact"), ("import x from \"react-dom/client\"", "react"), ("import { createApp } from 'vue'", "vue"), ("createApp(App).mount('#app')", "unknown"), ("import { render } from 'solid-js'", "solid"), ("let a = b <C", "unknown")])
_texts("p47_file_mount", S.file_mount_element, [(_RENDER, "root"), ("import { createApp } from 'vue'; createApp(App).mount('#app')", "app"), ("createApp(App).mount('#app')", None), ("const el = document.getElementById('main');", "main"), ("import App from 'svelte'; mount(App, { target: document.getElementById('t') })", "t"), ("x", None)])
_pairs("f20_transient_errors", S.is_transient, [("EPIPE", None, True), (None, "Request timeout", False), (None, "network down", False), (None, "fetch failed", False), (None, "The other side closed", True), ("X", "Connection reset by peer", True)], "BOOLEAN")
_case("f20_transient_causes", "codes array<string>, message string", [(["X", "EAI_AGAIN"], "m"), ([None, None], "m"), ([], "socket hang up"), (None, None)], lambda df: df.select("message", S.is_transient_chain(F.col("codes"), F.col("message")).alias("r")), "message:VARCHAR r:BOOLEAN", [("m", True), ("m", False), ("socket hang up", True), (None, False)])
_NAMES = ", ".join(f"n{i}" for i in range(400))
_texts("p24_long_imports", lambda c: F.array_join(SC.imports(c), ","), [(f"import {{ {_NAMES} }} from 'long'; const from = 'x'", "long"), (f"export {{ {_NAMES} }} from './all'", "./all"), ("let from = 'y'; from 'z'", "")])

# Declarations: P-25, P-28, P-29, P-35.
_shown = lambda c: F.array_join(F.transform(D.declared_imports(c), lambda x: F.concat_ws(":", x["source"], x["kind"], x["imported"], x["local"], F.when(x["type_only"], "type"))), ",")
_texts("p25_import_declarations", _shown, [
    ("import a, { b as c, type D } from 'x'; import * as n from \"y\"; import 's.css'", "x:default:default:a,x:named:b:c,x:named:D:D:type,y:namespace:*:n,s.css:side_effect"),
    ("import type { T } from './t'; import type from 'u'; import {} from 'v'", "./t:named:T:T:type,u:default:default:type,v:side_effect"), ("import('x'); import.meta.env; o.import 'y'; // import z from 'z'", ""), ("import { default as q } from 'q'", "q:named:default:q"),
])
_texts("p28_imported_names", lambda c: F.array_join(D.imported_names(c, "./util.ts"), ","), [("import d, { a as b, c } from './util'; import * as u from 'src/./util.ts'; import x from './utils'", "default,a,c,*"), ("import './util'", "")])
_texts("p29_member_accesses", lambda c: F.array_join(D.accessed_members(c, "styles"), ","), [("styles.a + styles['b-c'].d; x.styles.e; styles?.f; styles[g]; 'styles.h'", "a,b-c.d,f"), ("", "")])
_texts("p35_style_usage", lambda c: F.array_join(F.transform(D.used_classes(c), lambda x: F.concat_ws("#", x["source"], x["class"])), ","), [("import s from './a.module.css'; import * as t from '../b.module.scss'; import u from './c.css'; s.x; t['y']; u.z; s.x; s.toString()", "./a.module.css#x,../b.module.scss#y"), ("s.x", "")])

# Predicates.
_texts("f09_code_file", R.is_code, [("a/b.TSX", True), ("a.d/b", False), ("x.css", False), (".js", False), ("a.min.mjs", True)], "BOOLEAN")
_texts("f09_media", R.is_media, [("https://a.b/c.MP4?x=1", True), ("https://a.b/c?x=.mp4", False), ("/c.mp4", False), ("https://mp4", False)], "BOOLEAN")
_texts("f10_resource_type", lambda c: F.when(R.is_api_type(c), "api").when(R.is_static_type(c), "static").otherwise("other"), [("xhr", "api"), ("fetch", "api"), ("script", "static"), ("manifest", "static"), ("websocket", "other")])
_texts("f11_size", lambda c: R.passes_size(c, 100), [("", True), ("0", True), ("100", True), ("101", False), ("abc", True), ("101 bytes", False), ("-5", True)], "BOOLEAN")
_case("f18_version_context", "t string, at int", [("v = 1.2.3", 4), ("https://x.y/a/1.2.3", 14), ("f?v=1.2.3", 4), ("* @param {string} v 1.2.3", 19), ("[options.version='1.1.1']", 18), ("see https://x.y now a/b 1.2.3", 24)], lambda df: df.select("t", R.version_context(F.col("t"), F.col("at")).alias("r")), "t:VARCHAR r:BOOLEAN", [("v = 1.2.3", True), ("https://x.y/a/1.2.3", False), ("f?v=1.2.3", False), ("* @param {string} v 1.2.3", False), ("[options.version='1.1.1']", False), ("see https://x.y now a/b 1.2.3", True)])
_case("f22_extractable", "id int, c array<string>", [(1, None), (2, []), (3, [None]), (4, [None, ""])], lambda df: df.select("id", R.extractable(F.col("c")).alias("r")), "id:INTEGER r:BOOLEAN", [(1, False), (2, False), (3, False), (4, True)])
_texts("f23_entry", R.is_entry, [("<App />\ncreateRoot(x)", True), ("<App>\n" + "a()\n" * 11, True), ("<App>\n" + "import x\n// y\n * z\n\n" * 9, False), ("createRoot(x)", False)], "BOOLEAN")
_pairs("f23_stub_import", R.imports_stub, [("@use 'vars'", "a/vars.scss", True), ('@import "vars";', "vars.scss", True), ("@use 'vars.x'", "vars.scss", False), ("vars", "vars.scss", False)], "BOOLEAN")
_case("f23_injection", "id int, a array<string>, b array<string>", [(1, ["s"], ["x" * 1000]), (2, [], ["x" * 1000]), (3, ["s"], ["x" * 999]), (4, ["s"], [])], lambda df: df.select("id", R.needs_injection(F.col("a"), F.col("b")).alias("r")), "id:INTEGER r:BOOLEAN", [(1, True), (2, False), (3, False), (4, False)])
_texts("p34_style_imports", lambda c: F.array_join(R.style_imports(c), ","), [("@import url('./a.css'); @import \"../b.css\"; @import './a.css'; @import url(x.css);", "./a.css,../b.css"), ("", "")])
_pairs("u01_all_imports", lambda a, b: F.array_join(R.all_imports(F.split(a, ","), F.split(b, ",")), ","), [("./b,./a", "./a,./c", "./b,./a,./c"), ("./x", "./x", "./x")])
_texts("p36_style_map", R.style_map_url, [("a{}/*# sourceMappingURL=a.css.map */\n/*# sourceMappingURL=b.map */", "a.css.map"), ("/*@ sourceMappingURL=a */", None)])
_texts("p18_original_bundles", lambda c: F.array_join(F.transform(R.original_bundles(c), lambda x: F.concat_ws(":", x["type"], x["path"])), ","), [("<script defer src=\"/a.js\"></script><script src='//cdn/b.js'></script><link rel=\"stylesheet\" href=\"/c.css?v=1\"><link rel=preload href=\"/d.css\">", "script:/a.js,stylesheet:/c.css?v=1"), ("<script>x</script>", "")])
_case("g07_progress", "id int, p map<string,string>, c map<string,int>", [(1, {}, {}), (2, {"scrape": "completed"}, {"extracted": 2, "bundles": 5}), (3, {"scrape": "completed"}, {}), (4, {"scrape": "completed", "extract": "completed", "dependencies": "completed", "capture": "failed"}, {"captured": 1, "pages": 9}), (5, dict.fromkeys(("scrape", "extract", "dependencies", "capture", "rebuild"), "completed"), {})], lambda df: df.select("id", R.progress(F.col("p"), F.col("c")).alias("r")), "id:INTEGER r:VARCHAR", [(1, "Scraping bundles"), (2, "2/5 bundles extracted"), (3, "Extracting sources"), (4, "1/9 pages captured"), (5, "All phases completed")])

# Rebuilt projects.
_case("j28_fixed_versions", "name string, version string", [("a", "*"), ("b", "*"), ("c", "^1")], lambda df: B.fixed_versions(df, df.where("name = 'a'").select("name")), "name:VARCHAR version:VARCHAR outcome:VARCHAR", [("a", "latest", "fixed"), ("b", "workspace:*", "internal"), ("c", "^1", "kept")])
_case("j30_asset_mapping", "path string, type string", [("/x.js", "script"), ("/y.js", "script"), ("/z.css", "stylesheet")], lambda df: B.asset_mapping(df, df.sparkSession.createDataFrame([("index-2.js",), ("index-1.js",), ("a.css",)], "name string")), "path:VARCHAR type:VARCHAR rebuilt:VARCHAR", [("/x.js", "script", "/assets/index-1.js"), ("/y.js", "script", "/assets/index-1.js")])
_ranked = lambda df, order: df.select(*df.columns, F.row_number().over(order).alias("n"))
_case("t05_alias_order", "alias string, path string", [("@a", "1"), ("@a/b", "2"), ("@long", "3")], lambda df: B.by_specificity(df).limit(2), "alias:VARCHAR path:VARCHAR", [("@a/b", "2"), ("@long", "3")])
_case("t07_confidence_order", "path string, confidence double, ord int", [("a", 0.5, 0), ("b", 0.9, 1), ("c", 0.9, 2)], lambda df: B.by_confidence(df).limit(1), "path:VARCHAR confidence:DOUBLE ord:INTEGER", [("b", 0.9, 1)])
_case("ag19_queue_stats", "url string, depth int, status string", [("a", 0, "completed"), ("b", 1, "in_progress"), ("c", 1, "skipped"), ("d", 9, "queued")], lambda df: B.queue_stats(df, 5, 2), "visited:BIGINT skipped:BIGINT discovered:BIGINT max_depth_reached:BOOLEAN max_pages_reached:BOOLEAN", [(1, 2, 3, True, True)])
_case("g03_retries", "url string, retries int", [("a", 0), ("b", 2), ("c", 3)], lambda df: B.retried(df, 3), "url:VARCHAR retries:INTEGER status:VARCHAR wait_ms:BIGINT", [("a", 1, "queued", 500), ("b", 3, "queued", 2000), ("c", 3, "skipped", None)])
_case("ag21_missing", "name string", [("a",), ("b",), ("b",)], lambda df: B.missing_dependencies(df, df.where("name = 'a'")), "name:VARCHAR", [("b",)])


# Packages and projects.
_VENDOR = ["a/node_modules/@s/Lodash/x.js", "v/lodash-Abc123.js", "v/react-dom-AbC1d2.mjs", "v/react-17.0.2/index.js", "v/react/src/a.js", "react/src/a.js", "v/react-dom.js", "v\\react\\esm\\b.js", "v/my-1.2.3-4.5.6/x", "v/react/src"]
_case("j04_package_files", "path string", [(x,) for x in _VENDOR], lambda df: K.package_files(df, df.sparkSession.createDataFrame([("@s/lodash",), ("react",), ("react-dom",), ("my",), ("my-1.2.3",)], "name string")), "package:VARCHAR path:VARCHAR", [("@s/lodash", _VENDOR[0]), ("@s/lodash", _VENDOR[1]), ("react-dom", _VENDOR[2]), ("react", _VENDOR[3]), ("react", _VENDOR[4]), ("react", _VENDOR[7]), ("my", _VENDOR[8]), ("my-1.2.3", _VENDOR[8])])
_case("j26_alias_locations", "path string, ord int", [("nav/../../node_modules/@fp/pkg/x.js", 1), ("main/node_modules/@fp/pkg/y.js", 0), ("a/b.js", 2)], lambda df: K.alias_locations(df.sparkSession.createDataFrame([("p", "@fp/pkg"), ("q", "other")], "alias string, package string"), df), "alias:VARCHAR package:VARCHAR location:VARCHAR", [("p", "@fp/pkg", "./main/node_modules/@fp/pkg"), ("q", "other", "./node_modules/other")])
_case("f24_project_tests", "path string, content string", [("src/a.ts", "import './x.scss'"), ("b.module.css.ts", None), ("package.json", "{}")], lambda df: K.project_tests(df), "sass:BOOLEAN css_modules:BOOLEAN typescript:BOOLEAN built:BOOLEAN missing:VARCHAR", [(True, True, False, False, "vite.config.ts,index.html")])
_case("f17_package_folders", "path string", [("nav/x.ts",), ("utils/x.ts",), ("my_pkg/x.ts",), ("ui/src/a.tsx",), ("doc/readme.md",), ("deep/inner/readme.md",), ("out/dist/x.js",), ("root.ts",)], lambda df: K.package_folders(df), "folder:VARCHAR package:BOOLEAN", [("nav", True), ("utils", False), ("my_pkg", False), ("ui", True), ("doc", False), ("deep", True), ("out", False)])
_case("g09_closure", "src string, dst string", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("c", "f")], lambda df: K.closure(df.sparkSession.createDataFrame([("a",)], "path string"), df, 10, cut), "path:VARCHAR round:INTEGER", [("a", 0), ("b", 1), ("c", 2), ("f", 3)])

QUERIES = {k: v for k, v in _QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in _SQL.items() if k not in _before}


def crawl_in_order(spark, d):
    """G-01, T-04: a crawl that takes pages first in, first out, from each origin's first page, over the links of all pages."""
    p = PG._t(spark, d, "pages").select("page_id", "url", "html")
    named = p.select("page_id", U.origin(F.col("url")).alias("origin"), U.crawl_url(F.col("url")).alias("src"))
    edges = O.ordered_links(p).join(named, "page_id").groupBy("src", F.col("link").alias("dst")).agg(F.min(F.struct("page_id", "pos")).alias("m"))
    # Several pages of one address: the first one's links come first.
    edges = cut(edges.select("src", "dst", (F.col("m.page_id") * 100_000 + F.col("m.pos")).alias("pos")))
    seeds = named.groupBy("origin").agg(F.min("page_id").alias("pos"), F.min_by("src", "page_id").alias("url"))
    found = O.crawl_in_order(seeds, edges, max_depth=5, max_pages=1000, cut=cut)
    return found.select("url", "depth", F.array_join(F.transform("key", lambda x: x.cast("string")), ".").alias("key"))


def fixture_groups(spark, d):
    """A-G17: requests by method and pattern."""
    r = O.with_pattern(O.request_paths(PG._t(spark, d, "pages").select("page_id", "url")))
    return B.fixture_groups(r.select(F.col("page_id").alias("id"), "method", "pattern"))


def event_cache_stats(spark, d):
    """A-G20: entries and sizes of event bodies by kind."""
    return B.cache_stats(PG._t(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("body")))


def page_predicates(spark, d):
    """F-09, F-11, F-23: what the addresses and sizes of pages say."""
    path = U.url_path(F.col("url"))
    return PG._t(spark, d, "pages").select(
        "page_id", R.extension(path).alias("extension"), R.is_media(F.col("url")).alias("media"), R.is_code(path).alias("code"),
        R.passes_size(F.octet_length("html").cast("string"), 2000).alias("small"), R.is_entry(F.col("html")).alias("entry"),
    )


def document_versions(spark, d):
    """F-18: the first digit of each document, and whether it can begin a version by the text around it."""
    at = F.regexp_instr("text", F.lit("[0-9]")) - 1
    t = PG._t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", at.cast("int")).where("place >= 0")
    return t.select("doc_id", "place", R.version_context(F.col("text"), F.col("place")).alias("version"))


def scanned_files(spark, d):
    """S-09, S-12: pages written as files below a folder for each host, scanned again by name; files of other names and folders stay out."""
    p = PG._t(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("host"), F.concat(F.col("page_id").cast("string"), F.lit("\t"), F.length("html").cast("string")).alias("value"))
    from webloom.operators.tables import folder

    root = folder(spark)
    p.repartition("host").write.partitionBy("host").text(f"{root}/pages")
    p.limit(1).select("value").write.text(f"{root}/pages/node_modules")
    lines = FS.scan_files(spark, f"{root}/pages", "*.txt").select(F.regexp_extract("path", "^host=([^/]*)/", 1).alias("host"), F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.split("line", "\t")[1].cast("long")).alias("chars"))


_LINKS = f"""{PG._P}, l AS (SELECT page_id, origin, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS h FROM (SELECT page_id, origin, list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), lambda x: x LIKE '/%') AS h FROM p)),
  n AS (SELECT page_id, origin || {PG._ENC.replace('X', "CASE WHEN length(h) > 1 THEN regexp_replace(h, '/$', '') ELSE h END")} AS dst, min(pos) AS pos FROM l GROUP BY 1, 2),
  o AS (SELECT page_id, dst, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM n),
  c AS (SELECT page_id, origin, origin || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END || query AS src FROM p),
  e AS (SELECT src, dst, min(CAST(page_id AS BIGINT) * 100000 + pos) AS pos FROM o JOIN c USING (page_id) GROUP BY 1, 2),
  d0 AS (SELECT url, 0 AS depth, [min(pos)] AS key FROM (SELECT min_by(src, page_id) AS url, CAST(min(page_id) AS BIGINT) AS pos FROM c GROUP BY origin) GROUP BY url)"""
_DEPTHS = "".join(
    f",\n  d{k} AS (SELECT dst AS url, {k} AS depth, min(list_append(key, pos)) AS key FROM d{k - 1} JOIN e ON src = url WHERE dst NOT IN ({' UNION ALL '.join(f'SELECT url FROM d{j}' for j in range(k))}) GROUP BY dst)" for k in range(1, 6)
)
QUERIES |= {f.__name__: f for f in (crawl_in_order, fixture_groups, event_cache_stats, page_predicates, document_versions, scanned_files)}
ORACLE_SQL |= {
    "crawl_in_order": f"WITH {_LINKS}{_DEPTHS}, a AS ({' UNION ALL '.join(f'SELECT * FROM d{k}' for k in range(6))}), t AS (SELECT * FROM a ORDER BY depth, key LIMIT 1000) SELECT url, depth, array_to_string(key, '.') AS key FROM t",
    "fixture_groups": f"WITH {PG._REQ} SELECT 'GET ' || pattern AS key, count(*) AS n, min(page_id) AS first FROM r GROUP BY 1",
    "event_cache_stats": "SELECT event_type AS kind, count(*) AS n, coalesce(CAST(sum(length(props)) AS BIGINT), 0) AS chars FROM events GROUP BY 1",
    "page_predicates": rf"""WITH {PG._P}, x AS (SELECT *, lower(regexp_extract(path, '[^/](\.[^./]*)$', 1)) AS extension FROM p)
      SELECT page_id, extension, regexp_matches(lower(path), '\.(mp4|webm|ogg|ogv|mp3|wav|flac|aac|m4a|m4v|mov|avi|mkv)$') AS media, extension IN ('.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs') AS code, strlen(html) <= 2000 AS small,
        regexp_matches(html, '<[A-Z][a-zA-Z0-9]*[\s/>]') AND (regexp_matches(html, 'createRoot\s*\(|ReactDOM\.render\s*\(|\.render\s*\(\s*<|document\.getElementById\s*\(') OR len(list_filter(string_split(html, chr(10)), lambda l: NOT regexp_matches(trim(l), '^(import |export |//|/\*|\*|$)'))) > 10) AS entry FROM x""",
    "document_versions": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), d AS (SELECT doc_id, text, length(regexp_extract(text, '^[^0-9]*')) AS place FROM t WHERE regexp_matches(text, '[0-9]')),
      c AS (SELECT doc_id, CAST(place AS INTEGER) AS place, text[CAST(greatest(place - 100, 0) + 1 AS BIGINT):place] AS before, text[CAST(greatest(place - 100, 0) + 1 AS BIGINT):place + 100] AS around FROM d)
      SELECT doc_id, place, NOT (regexp_matches(before, 'https?://[^\s]*$') OR regexp_matches(before, '[?&][\w-]*=?\s*$') OR regexp_matches(before, '\[[\w.]*version') OR regexp_matches(before, '\[options\.')
        OR (regexp_matches(before, '/[\w.-]+/[\w.-]+$') AND contains(before, '://')) OR regexp_matches(around, '@param\s+\{')) AS version FROM c""".replace("\\", "\\"),
    "scanned_files": f"WITH {PG._P} SELECT host, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM p GROUP BY 1",
}
