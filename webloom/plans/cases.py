"""Queries over small fixed tables, one for each group of operators, with the rows they must give.

The inputs are cases of site artifacts that the driver tables do not hold: source maps,
style sheets, code, package versions and event logs. The SQL states the expected rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import code as C
from webloom.functions import html as H
from webloom.functions import paths as T
from webloom.functions import patterns as P
from webloom.functions import scanners as S
from webloom.functions import semver as V
from webloom.functions import sourcemaps as M
from webloom.functions import urls as U
from webloom.operators import graph as G
from webloom.streaming import wal as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def _case(name: str, shape: str, rows: list[tuple], plan, columns: str, expected: list[tuple]) -> None:
    """Register ``plan`` over the table ``rows``; ``columns`` names and types (SQL) the rows it must give."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(spark.createDataFrame(rows, shape))

    query.__name__ = name
    query.__doc__ = plan.__doc__
    QUERIES[name] = query
    fields = [c.split(":") for c in columns.split()]
    names = ", ".join(f'"{n}"' for n, _ in fields)
    typed = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in fields)
    values = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in expected)
    ORACLE_SQL[name] = f"SELECT {typed} FROM (VALUES {values}) AS t({names})"


def _texts(name: str, expression, pairs: list[tuple], kind: str = "VARCHAR") -> None:
    """A case of one text column: ``expression`` of each text must give its partner."""
    _case(name, "t string", [(a,) for a, _ in pairs], lambda df: df.select("t", expression(F.col("t")).alias("r")), f"t:VARCHAR r:{kind}", pairs)


def _pairs(name: str, expression, rows: list[tuple], kind: str = "VARCHAR") -> None:
    """A case of two text columns."""
    _case(name, "a string, b string", [r[:2] for r in rows], lambda df: df.select("a", "b", expression(F.col("a"), F.col("b")).alias("r")), f"a:VARCHAR b:VARCHAR r:{kind}", rows)


_csv = lambda f: lambda c: F.array_join(f(c), ",")

_pairs("c01_source_path", T.source_path, [
    ("webpack://app/./src/a.ts", "", "src/a.ts"), ("./src/a.ts", "", "src/a.ts"), ("../../x/b.ts", "", "../../x/b.ts"), ("a/../b/./c.ts", "", "b/c.ts"),
    ("a.ts", "src", "src/a.ts"), ("a.ts", "src/", "src/a.ts"), ("/abs/a.ts", "src", "abs/a.ts"), ("./a.ts", "src", "a.ts"), ("a/b/../../../c", "", "../c"),
])
_texts("c02_clean_filename", T.clean_filename, [("a/b.js?v=1", "b.js"), ("c.css", "c.css"), ("a/", ""), ("x/y?z/w", "y")])
_texts("c03_safe_path", T.safe_path, [("../../etc/passwd", "etc/passwd"), ("a/../../b", "b"), ("a<b>.ts", "a_b_.ts"), ("..", None), ("x\\y\\z.ts", "x/y/z.ts"), ("./a//b", "a/b"), ("a?b|c*", "a_b_c_")])
_texts("c04_bundle_rooted_path", T.bundle_rooted_path, [("app/../../x.ts", "app/x.ts"), ("app/a/../b.ts", "app/b.ts"), ("app", "app"), ("app/./c//d", "app/c/d")])
_pairs("c05_relative_path", T.relative_path, [("src/a/b.js", "./c.js", "src/a/c.js"), ("src/a/b.js", "../d.js", "src/d.js"), ("b.js", "../e.js", "../e.js"), ("/r/a.js", "./x", "/r/x")])
_texts("c06_posix_path", T.posix_path, [("a\\b\\c", "a/b/c"), ("a/b", "a/b")])
_texts("c07_bundle_name", T.bundle_name, [("/static/js/main.js", "js/main"), ("/app.css", "app"), ("/a/b.js.map", "a/b"), ("/", "bundle"), ("/x/y.css.map", "x/y")])
_texts("c08_package_of_specifier", T.package_of_specifier, [("react", "react"), ("react/jsx-runtime", "react"), ("@a/b", "@a/b"), ("@a/b/c/d", "@a/b"), ("@a", "@a")])
_texts("c09_package_of_path", T.package_of_path, [("x/node_modules/react/index.js", "react"), ("node_modules/@a/b/c.js", "@a/b"), ("src/a.ts", None), ("node_modules/a/node_modules/b/i.js", "a")])
_texts("c10_package_of_filename", T.package_of_filename, [
    ("lodash.js", "lodash"), ("vendor-react.js", "react"), ("chunk-Axios.js", "axios"), ("@turf-boolean-contains.js", "@turf/boolean"), ("vendor~moment~uuid.js", "moment"), ("react-dom-abc12345.js", "react-dom"), ("123.js", None),
])
_pairs("c11_map_url", lambda a, b: U.resolve(a, b), [
    ("https://x.io/js/a.js", "a.js.map", "https://x.io/js/a.js.map"), ("https://x.io/js/a.js", "/m/a.map", "https://x.io/m/a.map"), ("https://x.io/js/a.js", "//cdn.io/a.map", "https://cdn.io/a.map"),
    ("https://x.io/js/a.js", "http://y.io/a.map", "http://y.io/a.map"), ("https://x.io/js/a.js", "data:application/json;base64,e30=", "data:application/json;base64,e30="), ("https://x.io/a/b/c.js", "../d.map", "https://x.io/a/d.map"), ("not a url", "a.map", "a.map"),
])
_pairs("c12_link_url", U.resolve_link, [("https://x.io/a/b", "c?d=1", "https://x.io/a/c?d=1"), ("https://x.io/a", "#top", None), ("https://x.io/a", "mailto:q@x.io", None), ("https://x.io/a", " /z ", "https://x.io/z"), ("https://x.io/a", "JavaScript:void(0)", None), ("https://x.io/a/b?q=1", "?r=2", "https://x.io/a/b?r=2")])
_texts("c13_crawl_url", U.crawl_url, [("https://X.io/a/#f", "https://x.io/a"), ("https://x.io/", "https://x.io/"), ("https://x.io", "https://x.io/"), ("http://x.io:80/a/?q=1", "http://x.io/a?q=1"), ("https://x.io/für", "https://x.io/f%C3%BCr"), ("nope", "nope")])
_texts("c14_request_path", U.request_path, [("a/b/", "/a/b"), ("/", "/"), ("", "/"), ("/x", "/x")])
_texts("c15_with_scheme", U.with_scheme, [("x.io/a", "https://x.io/a"), ("http://x.io", "http://x.io"), ("HTTPS://x.io", "HTTPS://x.io")])
_pairs("c16_local_path", U.local_path, [("https://x.io/a/b.css", "https://x.io/", "a/b.css"), ("https://x.io/", "https://x.io/q", "index.html"), ("https://x.io/docs", "https://x.io/", "docs/index.html"), ("https://y.io/p/f n.png", "https://x.io/", "_external/4400654bae54_f_20n.png")])
_pairs("c17_content_type", lambda h, u: U.content_type(h, u), [("text/css; charset=utf-8", "https://x.io/a", "text/css"), (None, "https://x.io/a.woff2", "font/woff2"), (None, "https://x.io/a.avif", "application/octet-stream"), ("", "https://x.io/A.PNG?x", "image/png")])
_texts("c18_resource_type", U.resource_type, [("https://x.io/a.avif", "image"), ("https://x.io/a.mjs", "script"), ("https://x.io/a.m4a", "media"), ("https://x.io/a", "other"), ("https://x.io/f.otf", "font"), ("https://x.io/s.css?v=2", "stylesheet")])
_texts("c19_url_pattern", lambda c: P.url_pattern(c)["pattern"], [
    ("/users/42", "/users/:userId"), ("/api/products/7", "/api/:apiId/:productId"), ("/a/b?x=1", "/a/b"), ("/v/550e8400-e29b-41d4-a716-446655440000", "/v/:param0"), ("/x/1/2", "/x/:param0/:param1"), ("/categories/9/items/3", "/:categoryId/:categoryId/items/:itemId"), ("/", "/"),
])
_texts("c19_url_params", lambda c: F.array_join(P.url_pattern(c)["params"], ","), [("/users/42", "userId"), ("/x/1/2", "param0,param1"), ("/a", "")])
_texts("c20_priority", lambda c: P.url_pattern(c)["priority"], [("/users/42", 24), ("/a/b", 30), ("/", 0), ("/x/1/2", 33)], "INTEGER")
_texts("t01_sort_priority", P.sort_priority, [("/users/:userId", 26), ("/a/b", 30), ("/", 0)], "INTEGER")
_pairs("c23_fixture_filename", P.fixture_filename, [("GET", "/api/users/:userId", "GET_api_users_userId.json"), ("POST", "/a.b", "POST_a_b.json")])
_pairs("c23_fixture_id", lambda m, p: P.fixture_id(m, p, F.lit(7)), [("GET", "/api/users/:userId", "0007_GET_api-users-userId"), ("POST", "/", "0007_POST_")])
_texts("c24_query_params", lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(U.query_params(c)), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&"), [("https://x.io/?a=1&b=2&a=3", "a=3&b=2"), ("https://x.io/?q=a+b%21", "q=a b!"), ("https://x.io/", ""), ("https://x.io/?k", "k=")])
_texts("c27_data_uri", M.decode_data_uri, [("data:application/json;base64,e30=", "{}"), ("data:application/json;base64,%%", None), ("data:text/plain;base64,e30=", None), ("a.map", None)])
_texts("c28_strip_comments", S.without_comments, [("a /* x */ b", "a  b"), ("s = '//no'; // yes", "s = '//no'; "), ("`/*t*/`", "`/*t*/`"), ("x/*open", "x")])
_texts("c29_normalized_hash", lambda c: C.normalized_hash(S.without_comments(c)), [("a  b\n", "0cc9cd4dd26c5137b675a0d819cb9ab0"), ("a /*c*/ b", "0cc9cd4dd26c5137b675a0d819cb9ab0")])
_texts("c32_without_urls", C.without_urls, [("see https://x.io/v1.2.3 ok", "see  ok"), ("a?version=1.2.3", "a"), ("plain", "plain")])
_texts("c33_css_base_name", T.css_base_name, [("Button.module.css", "Button"), ("main-a1b2c3d4.css", "main"), ("app.0123abcd.css", "app"), ("x.min.scss", "x"), ("plain.less", "plain")])
_texts("c36_request_regex", P.request_regex, [("/a/:id", "^/a/([^/]+)$"), ("/a.b", "^/a\\.b$")])
_texts("f01_included", M.included, [("src/a.ts", True), ("(webpack)/x", False), ("vite/client", False), ("data:text", False), ("?x", False), ("__vite-b", False)], "BOOLEAN")
_texts("f02_skipped", U.skipped, [("https://x.io/a.pdf", True), ("https://x.io/a", False), ("mailto:x", True), ("https://x.io/A.ZIP?x", True)], "BOOLEAN")
_texts("f03_api_glob", lambda c: c.rlike("(?i)" + P.glob("**/api/**")), [("/v1/api/users", True), ("/other", False), ("/x/API/y/z", True)], "BOOLEAN")
_texts("f04_glob", lambda c: c.rlike("^" + P.glob("/a/*.js") + "$"), [("/a/b.js", True), ("/a/b/c.js", False), ("/a/b.jsx", False)], "BOOLEAN")
_texts("f06_map_content_type", M.valid_content_type, [("application/json", True), ("text/html; charset=x", False), ("", True), (None, True)], "BOOLEAN")
_texts("f07_builtin", G.is_builtin, [("fs", True), ("node:test", True), ("fs/promises", True), ("react", False)], "BOOLEAN")
_texts("f08_import_category", G.import_category, [("./a", "relative"), ("../b", "relative"), ("react", "external"), ("./x.module.css", "css_module"), ("./t.d.ts", "type_file"), ("@a/b", "external")])
_pairs("f12_vendor", C.looks_vendor, [("vendor.js", "x", True), ("main.js", "x", False), ("app-a1b2c3d4.js", "x", True), ("react.js", "x", True)], "BOOLEAN")
_pairs("f19_semver_range", V.satisfies, [
    ("18.2.0", "^18.0.0", True), ("17.0.0", "^18.0.0", False), ("18.2.0", "^18", True), ("1.2.3", "~1.2.0", True), ("1.3.0", "~1.2.0", False), ("2.0.0", ">=1.0.0 <3.0.0", True), ("3.0.0", ">=1.0.0 <3.0.0", False),
    ("16.1.0", "^15.0.0 || ^16.0.0", True), ("1.5.0", "1.0.0 - 2.0.0", True), ("2.1.0", "1.0.0 - 2.0.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("9.9.9", "*", True), ("1.2.9", "1.2", True), ("1.2.3", "=1.2.3", True),
], "BOOLEAN")
_texts("p02_comment_map_url", S.comments_map_url, [
    ("f();\n//# sourceMappingURL=a.js.map\n", "a.js.map"), ("//# sourceMappingURL=a.map\nf()", None), ("/*# sourceMappingURL=b.map */", "b.map"), ("//# sourceMappingURL=a\n//@ sourceMappingURL=b", "b"), ("x /* y\n# sourceMappingURL=c.map\n", "c.map"), ("none", None),
])
_texts("p02_css_map_url", lambda c: S.comments_map_url(c, "css"), [("a{}\n/*# sourceMappingURL=a.css.map */", "a.css.map"), ("//# sourceMappingURL=x", None)])
_texts("p03_map_url_at_end", M.map_url_at_end, [("f()\n//# sourceMappingURL=a.map", "a.map"), ("a{}/*# sourceMappingURL=b.map */\n", "b.map"), ("//# sourceMappingURL=a.map\nf()", None)])
_texts("p05_validation", lambda c: F.array_join(M.validation_codes(c), ","), [
    ('{"version":3,"sources":["a"],"mappings":""}', ""), ("nope", "INVALID_JSON"), ("[]", "INVALID_JSON"), ('{"version":2,"sources":[],"mappings":""}', "INVALID_VERSION"), ('{"sources":"x","mappings":1}', "MISSING_VERSION,SOURCES_NOT_ARRAY,INVALID_MAPPINGS"), ('{"version":3}', "MISSING_SOURCES,MISSING_MAPPINGS"),
])
_texts("p10_vlq", lambda c: F.array_join(F.transform(M.vlq(c), lambda x: x.cast("string")), ","), [("AAgBC", "0,0,16,1"), ("D", "-1"), ("gggggC", "33554432"), ("g", None), ("A!", None), ("2H", "123"), ("3H", "-123")])
_texts("p13_srcset", _csv(S.srcset), [("a.png 1x, b.png 2x", "a.png,b.png"), ("data:image/png;base64,AA,BB 1x, c.png 2x", "c.png"), ("a.png,b.png 300w", "a.png,b.png"), ("", "")])
_texts("p14_image_set", _csv(H.image_set_urls), [("image-set(url('a.png') 1x, url(b.png) 2x)", "a.png,b.png"), ('image-set("c.avif" 1x, "d.png" 2x)', "c.avif,d.png")])
_texts("p16_css_urls", _csv(H.css_urls), [("a{background:url('x.png')} b{src:url(y.woff)}", "x.png,y.woff"), ("@import 'z.css'; c{background:url(data:abc)}", "z.css"), ("d{fill:url(#g)}", "")])
_texts("p22_css_rewrite", lambda c: S.css_rewritten(c, {"x.png": "/l/x.png", "z.css": "/l/z.css"}), [("a{background:url('x.png')}", "a{background:url('/l/x.png')}"), ("@import \"z.css\";b{src:url(q)}", "@import \"/l/z.css\";b{src:url(q)}")])
_texts("p24_import_sources", _csv(S.imports), [("import a from 'x'; import 'y'", "x,y"), ("export * from \"z\"; const m = import('w')", "z,w"), ("// import 'no'\nrequire('v'); o.require('n')", "v"), ("let s = \"import 'n'\"", ""), ("import {from} from 'f'", "f")])
_texts("p26_exports", _csv(S.exports), [("export const a = 1; export function b() {}", "a,b"), ("export default c; export { d, e as f }", "default,d,f"), ("export { g } from 'h'; export * from 'm'", ""), ("export async function k() {}", "k"), ("export class Q {} export type T = 1", "Q,T")])
_texts("p38_hashed_classes", lambda c: F.array_join(F.transform(H.hashed_class_names(c), lambda x: F.concat_ws("=", x["base"], x["hashed"])), ","), [("._btn_a1b2c_3{} .card_x9y8z{}", "btn=_btn_a1b2c_3,card=card_x9y8z"), (".plain{}", "")])
_texts("p39_strings", _csv(C.string_literals), [("f('hello world', \"other text\")", "hello world,other text"), ("x='ab'", "")])
_texts("p39_calls", _csv(C.call_patterns), [("foo(a, b); bar(); fn(x)", "foo:2,bar:0"), ("if(a)", "")])
_pairs("p41_lockfile_version", C.lockfile_version, [("node_modules/.pnpm/react@18.2.0/node_modules/react/i.js", "react", "18.2.0"), ("node_modules/lodash/4.17.21/x.js", "lodash", "4.17.21"), ("src/a.ts", "a", None)])
_pairs("p42_map_path_version", C.map_path_version, [("node_modules/react@18.2.0/i.js", "react", "18.2.0"), ("node_modules/vue/v3.2.1/x.js", "vue", "3.2.1"), ("node_modules/react@18.2.0/i.js", "vue", None)])
_texts("p43_constant_version", C.constant_version, [('const VERSION = "1.2.3"', "1.2.3"), ("x.version='4.5.6-beta.1'", "4.5.6-beta.1"), ("see https://x.io?version=1.2.3", None), ('{"version": "7.8.9"}', "7.8.9")])
_texts("u04_similarity", lambda c: F.round(C.source_similarity(F.struct(F.lit("n").alias("normalized_hash"), F.lit("c").alias("content_hash"), F.lit("a|b|c|d").alias("signature"), F.lit(100).alias("length")), F.struct(F.lit("m").alias("normalized_hash"), F.lit("k").alias("content_hash"), c.alias("signature"), F.lit(50).alias("length"))), 6), [("a|b|c|d", 0.95), ("a|b|c", 0.775), ("z", 0.25), ("", 0.25)], "DOUBLE")


def _maps(df: DataFrame) -> DataFrame:
    """P-12, J-01, A-G18: statistics of extracted sources."""
    return M.extraction_stats(M.extract(df))


_MAP = json.dumps({"version": 3, "sources": ["webpack://app/./src/a.ts", "(webpack)/b", "c.ts"], "sourcesContent": ["x", "y", None], "mappings": "AAAA"})
_case("p12_extract_stats", "map_id long, json string", [(1, _MAP), (2, '{"version":3,"sources":["a"],"mappings":""}')], _maps, "map_id:BIGINT total:BIGINT extracted:BIGINT skipped:BIGINT null_content:BIGINT", [(1, 3, 1, 1, 1), (2, 1, 0, 0, 1)])
_case("p11_mapping_rows", "map_id long, mappings string", [(1, "AAAA,CAAC;AACA,EAAE")], M.mapping_rows, "map_id:BIGINT line:INTEGER seg:INTEGER column:BIGINT source:BIGINT src_line:BIGINT src_column:BIGINT name:BIGINT", [(1, 0, 0, 0, 0, 0, 0, None), (1, 0, 1, 1, 0, 0, 1, None), (1, 1, 0, 0, 0, 1, 1, None), (1, 1, 1, 2, 0, 1, 3, None)])
_case("w03_offset_order", "map_id long, i int, line int, column int", [(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 5, 1), (1, 3, -1, 0), (1, 4, 4, 9), (1, 5, 6, 0)], M.offset_order, "map_id:BIGINT i:INTEGER verdict:VARCHAR", [(1, 0, "ok"), (1, 1, "overlap"), (1, 2, "ok"), (1, 3, "invalid"), (1, 4, "unordered"), (1, 5, "ok")])


def _deps(df: DataFrame) -> DataFrame:
    """A-G01: packages and the files that import them."""
    return G.dependencies(df).select("package", F.array_join("files", ",").alias("files"))


_case("ag01_dependencies", "ord int, file string, spec string", [(1, "a.ts", "react"), (2, "b.ts", "react/jsx"), (3, "a.ts", "react"), (4, "a.ts", "./x"), (5, "b.ts", "fs"), (6, "b.ts", "@s/p/q")], _deps, "package:VARCHAR files:VARCHAR", [("react", "a.ts,b.ts"), ("@s/p", "b.ts")])


def _undefined(df: DataFrame) -> DataFrame:
    """J-08: variables used and nowhere defined."""
    return G.undefined_variables(df.where("kind = 'use'"), df.where("kind = 'def'")).select("file", F.array_join("names", ",").alias("names"))


_case("j08_undefined_variables", "kind string, file string, name string", [("use", "a", "x"), ("use", "a", "y"), ("def", "b", "y"), ("use", "b", "z"), ("use", "a", "w")], _undefined, "file:VARCHAR names:VARCHAR", [("a", "w,x"), ("b", "z")])


def _aliases(df: DataFrame) -> DataFrame:
    """J-11: aliases of scoped packages."""
    return G.import_aliases(df.where("kind = 'i'").select(F.col("t").alias("spec")), df.where("kind = 'f'").select(F.col("t").alias("path"), "ord"))


_case("j11_import_aliases", "kind string, t string, ord int", [("i", "core/x", 1), ("i", "react", 2), ("f", "node_modules/@a/core/i.js", 1), ("f", "node_modules/@b/core/i.js", 2), ("f", "node_modules/react/i.js", 3), ("f", "node_modules/@z/react/i.js", 4)], _aliases, "alias:VARCHAR package:VARCHAR", [("core", "@a/core")])


def _votes(df: DataFrame) -> DataFrame:
    """J-12: folders that aliases stand for."""
    return G.alias_votes(df.where("kind = 'i'").select(F.col("t").alias("spec")), df.where("kind = 'f'").select(F.col("t").alias("path")))


_case("j12_alias_votes", "kind string, t string", [("i", "ui/button"), ("i", "ui/card"), ("f", "src/ui/button.tsx"), ("f", "src/ui/card.tsx"), ("f", "lib/button.ts")], _votes, "alias:VARCHAR folder:VARCHAR confidence:VARCHAR", [("ui", "src/ui", "high")])


def _longest(df: DataFrame) -> DataFrame:
    """J-23: the most specific alias of an import."""
    return G.longest_alias(df.where("kind = 'i'").select(F.col("t").alias("spec")), df.where("kind = 'a'").select(F.col("t").alias("alias"), F.col("loc").alias("location")))


_case("j23_longest_alias", "kind string, t string, loc string", [("i", "@/ui/x", None), ("i", "@/y", None), ("i", "@app", None), ("a", "@", "src"), ("a", "@/ui", "src/components/ui")], _longest, "spec:VARCHAR target:VARCHAR", [("@/ui/x", "src/components/ui/x"), ("@/y", "src/y")])


def _peers(df: DataFrame) -> DataFrame:
    """J-18: versions whose known peers are all satisfied."""
    versions = df.where("kind = 'v'").groupBy("package", "version").agg(F.map_from_entries(F.collect_list(F.struct("peer", "rng"))).alias("peers"))
    return G.peer_versions(versions, df.where("kind = 'k'").select(F.col("package").alias("peer"), F.col("version").alias("peer_version")))


_case("j18_peer_versions", "kind string, package string, version string, peer string, rng string", [("v", "p", "1.0.0", "react", "^17.0.0"), ("v", "p", "2.0.0", "react", "^18.0.0"), ("v", "p", "2.1.0", "react", "^18.1.0"), ("v", "p", "3.0.0", "react", "^19.0.0"), ("k", "react", "18.2.0", None, None)], _peers, "package:VARCHAR version:VARCHAR matched:BIGINT", [("p", "2.1.0", 1)])
_case("t02_version_order", "package string, version string", [("p", "1.10.0"), ("p", "1.9.0"), ("p", "2.0.0-rc.1"), ("p", "1.10.1")], G.version_order, "package:VARCHAR version:VARCHAR rank:INTEGER", [("p", "1.10.1", 1), ("p", "1.10.0", 2), ("p", "1.9.0", 3), ("p", "2.0.0-rc.1", 4)])


def _division(df: DataFrame) -> DataFrame:
    """J-13: the one file that exports all names."""
    return G.files_with_all(df.where("kind = 'e'").select("package", "file", "name"), df.where("kind = 'w'").select("package", "name"))


_case("j13_files_with_all", "kind string, package string, file string, name string", [("e", "p", "a", "x"), ("e", "p", "a", "y"), ("e", "p", "b", "x"), ("w", "p", None, "x"), ("w", "p", None, "y"), ("e", "q", "c", "z"), ("e", "q", "d", "z"), ("w", "q", None, "z")], _division, "package:VARCHAR file:VARCHAR", [("p", "a")])


def _cascade(df: DataFrame) -> DataFrame:
    """X-01, J-02, U-02: versions by the first tier that knows one."""
    tier = lambda k: df.where(F.col("kind") == k).select("name", "version", "confidence")
    return G.version_cascade(df.where("kind = 'd'"), [("path", tier("path")), ("fingerprint", tier("fp")), ("npm", tier("npm"))])


_case("x01_version_cascade", "kind string, name string, version string, confidence string", [("d", "a", None, None), ("d", "b", None, None), ("d", "c", None, None), ("path", "a", "1.0.0", "exact"), ("fp", "a", "2.0.0", "high"), ("npm", "b", "3.0.0", "low")], _cascade, "name:VARCHAR version:VARCHAR confidence:VARCHAR source:VARCHAR", [("a", "1.0.0", "exact", "path"), ("b", "3.0.0", "low", "npm"), ("c", "*", "unverified", "none")])
_case("n01_package_json", "name string, version string, confidence string, is_private boolean", [("b", "1.0.0", "exact", False), ("a", "2.0.0", "high", False), ("c", "*", "none", False), ("d", "1", "exact", True)], lambda df: G.package_json(df, "site"), "json:VARCHAR", [('{"name":"site","private":true,"dependencies":{"a":"^2.0.0","b":"1.0.0","c":"*","d":"workspace:*"}}',)])
_case("n07_scss_stub", "name string", [("b",), ("a",), ("b",)], G.scss_stub, "text:VARCHAR", [("$a: unset !default;\n$b: unset !default;",)])


def _log(df: DataFrame) -> DataFrame:
    return W.valid_prefix(df)


_LOG = [
    (1, '{"seq":1,"timestamp":"t1","type":"phase:start","phase":"scrape"}'), (2, '{"seq":2,"timestamp":"t2","type":"phase:complete","phase":"scrape"}'),
    (3, '{"seq":3,"timestamp":"t3","type":"phase:start","phase":"extract"}'), (4, '{"seq":4,"timestamp":"t4","type":"extract:bundle","bundleName":"m","filesWritten":3}'),
    (5, '{"seq":5,"timestamp":"t5","type":"extract:bundle","bundleName":"m","filesWritten":9}'), (6, '{"seq":7,"timestamp":"t6","type":"phase:fail","phase":"extract","error":"e"}'),
    (7, '{"seq":8,"timestamp":"t7","type":"capture:page:started","url":"/a"}'), (8, "broken"), (9, '{"seq":9,"timestamp":"t8","type":"capture:page:completed","url":"/a"}'),
]
_case("s20_valid_prefix", "line_no int, text string", _LOG, lambda df: _log(df).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.bool_or("corrupted").alias("corrupted")), "n:BIGINT last_seq:BIGINT corrupted:BOOLEAN", [(7, 8, True)])
_case("w06_fold_phases", "line_no int, text string", _LOG, lambda df: W.fold_phases(_log(df)), "phase:VARCHAR status:VARCHAR started_at:VARCHAR completed_at:VARCHAR error:VARCHAR", [("scrape", "completed", "t1", "t2", None), ("extract", "failed", "t3", None, "e")])
_case("w06_fold_bundles", "line_no int, text string", _LOG, lambda df: W.fold_bundles(_log(df)), "bundle:VARCHAR files:BIGINT", [("m", 3)])
_case("g08_fold_pages", "line_no int, text string", _LOG, lambda df: W.fold_pages(_log(df)), "url:VARCHAR status:VARCHAR completed:BOOLEAN", [("/a", "started", False)])
_case("w04_first_gap", "line_no int, text string", _LOG, lambda df: W.first_gap(_log(df)), "gap:INTEGER", [(5,)])
_case("s01_bundle_urls", "html string", [('<script src="/a.js"></script><link rel="modulepreload" href="/a.js"><link rel="modulepreload" href="/b.js"><link rel="stylesheet" href="/c.css?v=1"><script src="/a.js"></script>',)], lambda df: df.select(F.array_join(F.transform(H.bundle_urls(F.col("html")), lambda x: F.concat_ws(":", x["kind"], x["url"])), ",").alias("urls")), "urls:VARCHAR", [("script:/a.js,script:/a.js,script:/b.js,stylesheet:/c.css?v=1",)])
