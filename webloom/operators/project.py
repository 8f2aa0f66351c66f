"""Operators on a recovered project: lookups, merges, layout, and text generated from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import semver as V
from webloom.functions import signals as S
from webloom.functions.paths import extension
from webloom.operators.tables import numbered


def banner_versions(deps: DataFrame, banners: DataFrame) -> DataFrame:
    """J-03: (name, version): each dependency's first banner with its name, else with its unscoped name.

    Both names are keys of one equi-join; the kind of match ranks before the banner's place.
    """
    keys = deps.select("name", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("kind"), F.lower("name").alias("key")), F.struct(F.lit(1).alias("kind"), F.lower(F.element_at(F.split("name", "/"), -1)).alias("key"))))).alias("k")).select("name", "k.*")
    hit = keys.join(banners.select(F.lower("banner").alias("key"), "version", "ord"), "key")
    return hit.groupBy("name").agg(F.min_by("version", F.struct("kind", "ord")).alias("version"))


def lookup_urls(refs: DataFrame, places: DataFrame) -> DataFrame:
    """J-06: (raw, local_path): by the resolved URL, else by the reference as it stands; null without either."""
    a = refs.join(places.select(F.col("key").alias("resolved"), F.col("local_path").alias("by_url")), "resolved", "left")
    b = a.join(places.select(F.col("key").alias("raw"), F.col("local_path").alias("by_raw")), "raw", "left")
    return b.select("raw", F.coalesce("by_url", "by_raw").alias("local_path"))


def missing_exports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """J-09: (index, name, type_only): names imported from an index that does not export them; type-only if every import is."""
    wanted = imports.groupBy("index", "name").agg(F.bool_and("type_only").alias("type_only"))
    return wanted.join(exports.select("index", "name"), ["index", "name"], "left_anti")


def matching_bundles(css: DataFrame, bundles: DataFrame) -> DataFrame:
    """J-16: (path, bundle): for each style sheet the bundle of the same base name that shares most path segments."""
    segs = lambda c: F.split(c, "/")
    score = F.size(F.array_intersect(segs(F.col("path")), segs(F.col("bundle"))))
    return css.join(bundles, "base").withColumn("score", score).groupBy("path").agg(F.min_by("bundle", F.struct(-F.col("score"), "ord")).alias("bundle"))


def valid_versions(deps: DataFrame, published: DataFrame) -> DataFrame:
    """J-27: (name, version): versions that were published; else the package's highest release, or null if it has none."""
    latest = published.where(~V.is_prerelease(F.col("version"))).groupBy("name").agg(F.max_by("version", V.numbers(F.col("version"))).alias("latest"))
    known = published.select("name", "version").distinct().withColumn("hit", F.lit(True))
    return deps.join(known, ["name", "version"], "left").join(latest, "name", "left").select("name", F.when(F.col("hit"), F.col("version")).otherwise(F.col("latest")).alias("version"))


def split_bundles(bundles: DataFrame) -> DataFrame:
    """J-31: bundles with with_map, vendor and without_map; vendor bundles are without a map too."""
    from webloom.functions.code import looks_vendor

    has = F.col("map_url").isNotNull()
    return bundles.select("url", has.alias("with_map"), (~has & looks_vendor(F.element_at(F.split("url", "/"), -1), F.col("content"))).alias("vendor"), (~has).alias("without_map"))


def merged_usage(usages: DataFrame) -> DataFrame:
    """A-G08: (local, members, called, files): what all files do with an imported name."""
    return usages.groupBy("local").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"), F.bool_or("called").alias("called"), F.array_sort(F.collect_set("file")).alias("files"))


def env_variables(files: DataFrame) -> DataFrame:
    """A-G10: (name, files): environment variables and the files that read them, with repeats, in order."""
    rows = files.select("ord", "path", F.posexplode(S.env_accesses(F.col("content"))).alias("pos", "name"))
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "path"))), lambda x: x["path"]).alias("files"))


def vendor_folders(files: DataFrame) -> DataFrame:
    """A-G12: top folders with over four fifths of their files below node_modules."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    return files.groupBy(top.alias("folder")).agg(F.avg(F.col("path").contains("node_modules/").cast("int")).alias("share")).where("share > 0.8").select("folder")


def distinct_exports(exports: DataFrame) -> DataFrame:
    """W-05: the first export of each (file, name)."""
    return exports.groupBy("file", "name").agg(F.min("pos").alias("pos"))


def search_order(versions: DataFrame, hint: str) -> DataFrame:
    """W-08: (version, rank): tagged versions first, then by their distance from the hint, newer ones winning ties."""
    v, h = V.numbers(F.col("version")), V.numbers(F.lit(hint))
    gap = F.abs(v[0] - h[0]) * 1_000_000 + F.abs(v[1] - h[1]) * 1_000 + F.abs(v[2] - h[2])
    ranked = numbered(versions, [F.col("tag").isNull(), gap, F.desc("published"), F.col("version")], "rank")
    return ranked.select("version", (F.col("rank") + 1).cast("int").alias("rank"))


def first_found(attempts: DataFrame) -> DataFrame:
    """S-25: (key, value): the first attempt that gave a value."""
    return attempts.where("value is not null").groupBy("key").agg(F.min_by("value", "rank").alias("value"))


def manifest(files: DataFrame) -> DataFrame:
    """K-02, A-G07: (name, key, n): files by extension and by top folder, and in all, in one pass."""
    from webloom.operators.pages import histogram

    return histogram(files, {"extension": extension(F.col("path")), "folder": F.split_part("path", F.lit("/"), F.lit(1))})


def barrel(exports: DataFrame) -> DataFrame:
    """N-03: (folder, text): an index for each folder; a name goes to the first file that exports it, and files
    of tests, stories and declarations are passed over."""
    own = exports.where(~F.col("file").rlike(r"\.(test|spec|stories)\.[jt]sx?$|\.d\.ts$"))
    first = own.groupBy("folder", "name").agg(F.min("file").alias("file"))
    module = F.regexp_replace(F.col("file"), r"\.[jt]sx?$", "")
    lines = first.groupBy("folder", module.alias("module")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    line = F.format_string("export { %s } from './%s';", "names", "module")
    return lines.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def css_module_stub(classes: DataFrame) -> DataFrame:
    """N-06: (file, text): an empty rule for each class that a module's importers use, sorted."""
    return classes.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set(F.format_string(".%s {}", "name"))), "\n").alias("text"))


def export_statement(kind: Column, name: Column, source: Column) -> Column:
    """N-09: the statement that provides a missing export."""
    return F.when(kind == "namespace", F.format_string("export * as %s from '%s';", name, source)).when(kind == "reexport", F.format_string("export { %s } from '%s';", name, source)).otherwise("")


def env_example(variables: DataFrame) -> DataFrame:
    """N-08: one text with a line for each variable, sorted."""
    return variables.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.col("name"), F.lit("=")))), "\n").alias("text"))
