"""Queries of the project operators over small fixed tables, with the rows they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import project as R
from webloom.plans.cases import ORACLE_SQL as _SQL
from webloom.plans.cases import QUERIES as _QUERIES
from webloom.plans.cases import _case

_before = set(_QUERIES)
_k = lambda df, kind: df.where(F.col("kind") == kind)

_case("j03_banner_versions", "kind string, name string, version string, ord int", [("d", "@a/core", None, 0), ("d", "vue", None, 0), ("d", "x", None, 0), ("b", "Vue", "3.0.0", 1), ("b", "vue", "2.0.0", 2), ("b", "core", "1.0.0", 3)], lambda df: R.banner_versions(_k(df, "d"), _k(df, "b").withColumnRenamed("name", "banner")), "name:VARCHAR version:VARCHAR", [("@a/core", "1.0.0"), ("vue", "3.0.0")])
_case("j06_lookup_urls", "kind string, a string, b string", [("r", "/x.png", "https://s.io/x.png"), ("r", "y.png", "https://s.io/y.png"), ("r", "z", "https://s.io/z"), ("p", "https://s.io/x.png", "l/x"), ("p", "y.png", "l/y")], lambda df: R.lookup_urls(_k(df, "r").select(F.col("a").alias("raw"), F.col("b").alias("resolved")), _k(df, "p").select(F.col("a").alias("key"), F.col("b").alias("local_path"))), "raw:VARCHAR local_path:VARCHAR", [("/x.png", "l/x"), ("y.png", "l/y"), ("z", None)])
_case("j09_missing_exports", "kind string, index string, name string, type_only boolean", [("i", "a", "x", True), ("i", "a", "x", False), ("i", "a", "T", True), ("i", "a", "y", False), ("e", "a", "y", None), ("e", "b", "x", None)], lambda df: R.missing_exports(_k(df, "i"), _k(df, "e")).select("name", "type_only"), "name:VARCHAR type_only:BOOLEAN", [("x", False), ("T", True)])
_case("j16_matching_bundles", "kind string, base string, p string, ord int", [("c", "btn", "src/ui/btn.scss", 0), ("b", "btn", "static/btn.css", 1), ("b", "btn", "static/ui/btn.css", 2), ("b", "card", "static/ui/card.css", 3)], lambda df: R.matching_bundles(_k(df, "c").select("base", F.col("p").alias("path")), _k(df, "b").select("base", F.col("p").alias("bundle"), "ord")), "path:VARCHAR bundle:VARCHAR", [("src/ui/btn.scss", "static/ui/btn.css")])
_case("j27_valid_versions", "kind string, name string, version string", [("d", "a", "1.0.0"), ("d", "b", "9.9.9"), ("d", "c", "1.0.0"), ("p", "a", "1.0.0"), ("p", "b", "2.0.0"), ("p", "b", "10.0.0"), ("p", "b", "11.0.0-rc.1")], lambda df: R.valid_versions(_k(df, "d").drop("kind"), _k(df, "p").drop("kind")), "name:VARCHAR version:VARCHAR", [("a", "1.0.0"), ("b", "10.0.0"), ("c", None)])
_case("j31_split_bundles", "url string, map_url string, content string", [("/a.js", "/a.js.map", "x"), ("/vendor.js", None, "x"), ("/app.js", None, "x")], R.split_bundles, "url:VARCHAR with_map:BOOLEAN vendor:BOOLEAN without_map:BOOLEAN", [("/a.js", True, False, False), ("/vendor.js", False, True, True), ("/app.js", False, False, True)])
_case("ag08_merged_usage", "local string, member string, called boolean, file string", [("q", "a", False, "f1"), ("q", "b", True, "f2"), ("q", "a", False, "f2"), ("r", "c", False, "f1")], lambda df: R.merged_usage(df.withColumn("members", F.array("member"))).select("local", F.array_join("members", ",").alias("members"), "called", F.array_join("files", ",").alias("files")), "local:VARCHAR members:VARCHAR called:BOOLEAN files:VARCHAR", [("q", "a,b", True, "f1,f2"), ("r", "c", False, "f1")])
_case("ag10_env_variables", "ord int, path string, content string", [(1, "a.ts", "process.env.KEY + process.env.KEY"), (2, "b.ts", "import.meta.env.KEY; process.env.NODE_ENV")], lambda df: R.env_variables(df).select("name", F.array_join("files", ",").alias("files")), "name:VARCHAR files:VARCHAR", [("KEY", "a.ts,a.ts,b.ts")])
_case("ag12_vendor_folders", "path string", [("v/node_modules/a.js",), ("v/node_modules/b.js",), ("s/a.ts",), ("s/node_modules/c.js",)], R.vendor_folders, "folder:VARCHAR", [("v",)])
_case("w05_distinct_exports", "file string, name string, pos int", [("a", "x", 5), ("a", "x", 2), ("a", "y", 9), ("b", "x", 1)], R.distinct_exports, "file:VARCHAR name:VARCHAR pos:INTEGER", [("a", "x", 2), ("a", "y", 9), ("b", "x", 1)])
_case("w08_search_order", "version string, tag string, published long", [("1.0.0", None, 1), ("2.0.0", None, 3), ("1.1.0", None, 2), ("3.0.0", "latest", 4)], lambda df: R.search_order(df, "1.0.5"), "version:VARCHAR rank:INTEGER", [("3.0.0", 1), ("1.0.0", 2), ("1.1.0", 3), ("2.0.0", 4)])
_case("s25_first_found", "key string, rank int, value string", [("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None)], R.first_found, "key:VARCHAR value:VARCHAR", [("a", "x")])
_case("k02_manifest", "path string", [("src/a.ts",), ("src/b.css",), ("lib/c.ts",)], R.manifest, "name:VARCHAR key:VARCHAR n:BIGINT", [("total", None, 3), ("extension", ".ts", 2), ("extension", ".css", 1), ("folder", "src", 2), ("folder", "lib", 1)])
_case("n03_barrel", "folder string, file string, name string", [("ui", "b.ts", "x"), ("ui", "a.ts", "x"), ("ui", "b.ts", "y"), ("ui", "b.ts", "z"), ("ui", "c.test.ts", "q")], R.barrel, "folder:VARCHAR text:VARCHAR", [("ui", "export { x } from './a';\nexport { y, z } from './b';")])
_case("n06_css_module_stub", "file string, name string", [("a.css", "q"), ("a.css", "b"), ("a.css", "q")], R.css_module_stub, "file:VARCHAR text:VARCHAR", [("a.css", ".b {}\n.q {}")])
_case("n08_env_example", "name string", [("KEY",), ("API",), ("KEY",)], R.env_example, "text:VARCHAR", [("API=\nKEY=",)])
_case("n09_export_statement", "kind string, name string, source string", [("namespace", "a", "./a"), ("reexport", "b", "lib"), ("stub", "c", "")], lambda df: df.select("kind", R.export_statement(F.col("kind"), F.col("name"), F.col("source")).alias("text")), "kind:VARCHAR text:VARCHAR", [("namespace", "export * as a from './a';"), ("reexport", "export { b } from 'lib';"), ("stub", "")])

QUERIES = {k: v for k, v in _QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in _SQL.items() if k not in _before}
