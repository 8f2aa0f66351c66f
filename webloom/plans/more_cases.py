"""Further queries over small fixed tables, with the rows they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import code as C
from webloom.functions import signals as S
from webloom.operators import graph as G
from webloom.operators import pages as O
from webloom.plans.cases import ORACLE_SQL as _SQL
from webloom.plans.cases import QUERIES as _QUERIES
from webloom.plans.cases import _case, _pairs, _texts

_before = set(_QUERIES)
_show = lambda f: lambda c: F.array_join(f(c), ",")
_set = lambda c: F.filter(F.split(c, ","), lambda x: x != "")

_texts("c25_kept_headers", lambda c: F.array_join(F.map_keys(S.kept_headers(F.create_map(c, F.lit("v"), F.lit("X-Own"), F.lit("w")))), ","), [("ETag", "x-own"), ("Content-Type", "content-type,x-own"), ("Set-Cookie", "x-own")])
_pairs("c26_body_kind", S.body_kind, [("application/json", '{"a":1}', "json"), ("application/json", "{a", "text"), ("text/plain", "x", "text"), ("image/png", "x", "binary")])
_texts("c30_signature", lambda c: S.signature(_set(c)), [("foo,ba,bar,foo", "bar|foo"), ("a", "")])
_texts("c31_set_hash", lambda c: C.set_hash(_set(c)), [("b,a", "8cdeb44417f3c26826595d5820cf5700"), ("a,b", "8cdeb44417f3c26826595d5820cf5700")])
_texts("c34_retry_after", lambda c: S.retry_after_ms(c, F.timestamp_millis(F.lit(0))), [("120", 120000), ("Thu, 01 Jan 1970 00:00:05 GMT", 5000), ("soon", None)], "BIGINT")
_texts("c34_backoff", lambda c: S.backoff_ms(c.cast("int")), [("0", 500), ("2", 2000), ("9", 5000)], "BIGINT")
_texts("c34_human_bytes", lambda c: S.human_bytes(c.cast("long")), [("10", "10 B"), ("2048", "2.0 KB"), ("1572864", "1.5 MB")])
_texts("f05_asset_filter", lambda c: S.passes_asset_filter(c, F.lit("image/png"), extensions=(".png", ".svg"), types=("image/",), exclude=("**/tmp/**",)), [("/a/b.png", True), ("/a/b.css", False), ("/a/tmp/b.png", False)], "BOOLEAN")
_texts("f15_render_call", S.has_render_call, [("createRoot(document.getElementById('root')).render(x)", True), ("render()", False)], "BOOLEAN")
_texts("f16_css_property", S.is_css_property, [("Color", True), ("button", False)], "BOOLEAN")
_pairs("f20_transient", S.is_transient, [("ECONNRESET", None, True), (None, "Socket hang up", True), ("EACCES", "denied", False)], "BOOLEAN")
_texts("f21_error_family", S.error_family, [("INVALID_VLQ", "vlq"), ("INVALID_JSON", "parse"), ("TIMEOUT", "network"), ("MISSING_SOURCES", "validation")])
_texts("f26_cache_fresh", lambda c: S.fresh(c.cast("long"), F.lit(604_800_000).cast("long")), [("1", True), ("0", False)], "BOOLEAN")
_texts("p27_asset_placeholder", S.asset_placeholder, [('export default "__VITE_ASSET__a1b2__"', "__VITE_ASSET__a1b2__"), ("export default x", None)])
_texts("p30_env_accesses", _show(S.env_accesses), [("process.env.API_URL + import.meta.env.MODE; process.env.NODE_ENV", "API_URL,MODE"), ("import.meta.env.VITE_KEY", "VITE_KEY,KEY")])
_texts("p37_scss_definitions", _show(S.scss_definitions), [("$a: 1;\n$b: $a;\n@each $k, $v in $m {}", "a,b,k,v"), ("x{y:$z}", "")])
_texts("p37_scss_usages", _show(S.scss_usages), [("$a: 1;\nx { y: $a + $c; }", "a,c"), ("x{}", "")])
_texts("p40_file_names", lambda c: F.array_join(S.file_names(_set(c)), ","), [("src/Button.tsx,lib/button.js,a/_x.ts", "_x,button")])
_texts("p44_banner_version", S.banner_version, [("/*! jquery v3.6.0 */", "3.6.0"), ("/** @version 1.2.3 */", "1.2.3"), ("x", None)])
_texts("p46_build_errors", lambda c: F.array_join(F.transform(S.build_errors(c), lambda e: F.concat_ws(":", e["kind"], e["subject"])), ","), [("Error: Cannot find module 'react'\nTS2304: Cannot find name 'Foo'.", "missing-module:react,missing-type:Foo"), ("ok", ""), ("process.env.KEY is undefined", "missing-env:KEY")])
_texts("p47_mount_element", S.mount_element, [("createRoot(document.getElementById('root'))", "root"), ("createApp(App).mount('#app')", "app"), ("x", None)])
_texts("p47_framework", S.framework, [("createApp(App).mount('#app')", "vue"), ("hydrateRoot(document.getElementById('root'))", "react"), ("x", "unknown")])
_pairs("u03_jaccard", lambda a, b: C.jaccard(_set(a), _set(b)), [("a,b", "b,c", 1 / 3), ("", "a", 0.0), ("a", "a", 1.0)], "DOUBLE")
_pairs("u05_minified_similarity", lambda a, b: F.round(C.minified_similarity(a.cast("double"), b.cast("double"), F.lit(0.5), F.lit(0.8)), 6), [("0.6", "0.6", 0.715), ("0.2", "0.9", 0.58), ("1", "1", 0.995)], "DOUBLE")
_pairs("u06_multi_file_similarity", lambda a, b: F.round(C.multi_file_similarity(a.cast("double"), b.cast("double"), F.lit(0.5)), 6), [("0.5", "0.5", 0.6), ("0.2", "0.9", 0.54)], "DOUBLE")
_pairs("u07_structural_similarity", lambda a, b: F.round(S.structural_similarity(_set(a), _set(b)), 6), [("a,b,_c", "a,b,_c", 1.0), ("a,b", "a,c", 0.2), ("", "a", 0.0)], "DOUBLE")


def _best(df: DataFrame) -> DataFrame:
    """J-19: the best candidate version of each file."""
    print_of = F.struct(F.col("hash").alias("normalized_hash"), F.col("hash").alias("content_hash"), F.col("sig").alias("signature"), F.col("n").alias("length"))
    files = df.where("kind = 'f'").select("package", F.col("name").alias("file"), print_of.alias("f"))
    candidates = df.where("kind = 'c'").select("package", F.col("name").alias("version"), F.col("rank").alias("search_rank"), print_of.alias("g"))
    return G.best_matches(files, candidates).select("file", "version", F.round("similarity", 6).alias("similarity"))


_case("j19_best_matches", "kind string, package string, name string, hash string, sig string, n int, rank int", [
    ("f", "p", "x.js", "h1", "a|b|c|d", 100, 0), ("c", "p", "1.0.0", "h2", "a|b|c|d", 100, 1), ("c", "p", "1.1.0", "h1", "q", 10, 2), ("f", "p", "y.js", "h9", "a|b|c", 50, 0), ("f", "q", "z.js", "h1", "a|b|c|d", 1, 0),
], _best, "file:VARCHAR version:VARCHAR similarity:DOUBLE", [("x.js", "1.1.0", 1.0), ("y.js", "1.0.0", 0.775)])
_case("j21_merge_redirects", "kind string, f string, t string", [("s", "/a", "/b"), ("b", "/a", "/c"), ("b", "/d", "/e")], lambda df: G.merge_redirects(df.where("kind = 's'").select(F.col("f").alias("from"), F.col("t").alias("to")), df.where("kind = 'b'").select(F.col("f").alias("from"), F.col("t").alias("to"))), "from:VARCHAR to:VARCHAR", [("/a", "/b"), ("/d", "/e")])
_case("ag09_class_name_map", "base string, hashed string", [("btn", "btn_2"), ("btn", "btn_1"), ("btn", "btn_2"), ("card", "card_x")], lambda df: G.class_name_map(df).select("base", F.array_join("hashed", ",").alias("hashed")), "base:VARCHAR hashed:VARCHAR", [("btn", "btn_1,btn_2"), ("card", "card_x")])
_case("j29_resolve_classes", "kind string, base string, hashed string", [("m", "btn", "btn_1"), ("n", "btn", None), ("n", "other", None)], lambda df: G.resolve_classes(df.where("kind = 'n'").select(F.col("base").alias("name")), G.class_name_map(df.where("kind = 'm'").select("base", "hashed"))), "name:VARCHAR resolved:VARCHAR", [("btn", "btn_1"), ("other", "other")])
_case("ag16_package_features", "package string, content string", [("p", "foo(a); x = 'hello there'; 1234"), ("p", "bar(); 5.5")], lambda df: G.package_features(df).select("package", F.array_join("strings", ",").alias("strings"), F.array_join("calls", ",").alias("calls"), F.array_join("numbers", ",").alias("numbers"), "length", "files"), "package:VARCHAR strings:VARCHAR calls:VARCHAR numbers:VARCHAR length:BIGINT files:BIGINT", [("p", "hello there", "bar:0,foo:1", "1234,5.5", 41, 2)])


def _by_peer(df: DataFrame) -> DataFrame:
    """J-17: versions by the most specific range that a known peer satisfies."""
    versions = df.where("kind = 'v'").groupBy("package", "version").agg(F.map_from_entries(F.collect_list(F.struct("peer", "rng"))).alias("peers"))
    return G.version_by_peer(versions, df.where("kind = 'k'").select(F.col("package").alias("peer"), F.col("version").alias("peer_version")))


_case("j17_version_by_peer", "kind string, package string, version string, peer string, rng string", [("v", "p", "1.0.0", "react", "18.2.0"), ("v", "p", "2.0.0", "react", "^18.0.0"), ("v", "q", "1.0.0", "react", ">=16.0.0"), ("v", "q", "1.5.0", "react", ">=17.0.0"), ("k", "react", "18.2.0", None, None)], _by_peer, "package:VARCHAR version:VARCHAR peer:VARCHAR specificity:INTEGER", [("p", "1.0.0", "react", 3), ("q", "1.5.0", "react", 0)])
_case("p20_url_map", "url string, local_path string, ord int", [("https://x.io/a?v=1", "one", 1), ("https://x.io/a?v=1", "two", 2), ("https://y.io/b", "three", 3)], lambda df: O.url_map(df, F.lit("https://x.io/")), "key:VARCHAR local_path:VARCHAR", [("https://x.io/a?v=1", "two"), ("/a?v=1", "one"), ("https://y.io/b", "three")])
_case("w01_keep_first", "method string, pattern string, ord int, id string", [("GET", "/a", 2, "y"), ("GET", "/a", 1, "x"), ("POST", "/a", 3, "z")], lambda df: O.keep_first(df, ["method", "pattern"], "ord"), "method:VARCHAR pattern:VARCHAR ord:INTEGER id:VARCHAR", [("GET", "/a", 1, "x"), ("POST", "/a", 3, "z")])

QUERIES = {k: v for k, v in _QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in _SQL.items() if k not in _before}
