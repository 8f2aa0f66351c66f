"""Operators on code tables: files, imports, packages, versions, fingerprints, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import code as C
from webloom.functions import semver as V
from webloom.functions.paths import package_of_path, package_of_specifier

# Modules that a runtime brings along.
BUILTINS = (
    "assert buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https inspector "
    "module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls tty url "
    "util v8 vm wasi worker_threads zlib"
).split()


def is_builtin(spec: Column) -> Column:
    """F-07: whether an import names a module of the runtime."""
    return spec.startswith("node:") | F.split_part(spec, F.lit("/"), F.lit(1)).isin(BUILTINS)


def import_category(spec: Column) -> Column:
    """F-08: what an import is of."""
    return F.when(spec.rlike(r"\.module\.(css|scss|sass|less)$"), "css_module").when(spec.rlike(r"\.d\.ts$"), "type_file").when(spec.rlike(r"^\.{0,2}/|^\.{1,2}$"), "relative").otherwise("external")


def dependencies(imports: DataFrame) -> DataFrame:
    """A-G01: (package, files) of ``imports`` (ord, file, spec): packages with the files that import them,
    each once, in order. Files combine on the map side before packages meet."""
    own = imports.where(~is_builtin(F.col("spec")) & (import_category(F.col("spec")) == "external"))
    once = own.groupBy(package_of_specifier(F.col("spec")).alias("package"), "file").agg(F.min("ord").alias("ord"))
    return once.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file"))), lambda x: x["file"]).alias("files"))


def undefined_variables(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """J-08: (file, names): variables that a file uses and no file defines."""
    return usages.join(definitions.select("name").distinct(), "name", "left_anti").groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("names"))


def import_aliases(imports: DataFrame, files: DataFrame) -> DataFrame:
    """J-11: (alias, package): imported names that are no package themselves but the unscoped part of one; first wins."""
    packages = files.select(package_of_path(F.col("path")).alias("package"), "ord").where("package is not null").groupBy("package").agg(F.min("ord").alias("ord"))
    names = imports.select(package_of_specifier(F.col("spec")).alias("alias")).distinct().join(packages.select(F.col("package").alias("alias")), "alias", "left_anti")
    scoped = packages.where(F.col("package").startswith("@")).withColumn("alias", F.split_part("package", F.lit("/"), F.lit(2)))
    return names.join(scoped, "alias").groupBy("alias").agg(F.min_by("package", "ord").alias("package"))


def alias_votes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """J-12: (alias, folder, confidence): the folder that holds most of an alias's sub-paths, the shortest on ties.

    Each file offers all of its path's suffixes, so the sub-paths meet them in an equi-join.
    """
    wanted = imports.select(F.split_part("spec", F.lit("/"), F.lit(1)).alias("alias"), F.regexp_extract("spec", r"^[^/]+/(.+)$", 1).alias("sub")).where("sub <> ''").distinct()
    clean = files.select(F.split(F.regexp_replace("path", r"\.[jt]sx?$", ""), "/").alias("s"))
    offers = clean.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(F.array_join(F.slice("s", 1, i - 1), "/").alias("folder"), F.array_join(F.slice("s", i, F.size("s")), "/").alias("sub")))).alias("o")).select("o.*").distinct()
    total = wanted.groupBy("alias").agg(F.count("*").alias("wanted"))
    found = wanted.join(offers, "sub").groupBy("alias", "folder").agg(F.count("*").alias("n"))
    best = found.groupBy("alias").agg(F.min_by(F.struct("folder", "n"), F.struct(-F.col("n"), F.length("folder"), "folder")).alias("b"))
    share = F.col("n") / F.col("wanted")
    return best.select("alias", "b.*").join(total, "alias").select("alias", "folder", F.when(share >= 1, "high").when(share >= 0.5, "medium").otherwise("low").alias("confidence"))


def longest_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """J-23: (spec, target): the most specific alias (segments, then length) that an import is or begins with; the rest of the path stays.

    An import offers all of its own prefixes, so no pattern join is needed.
    """
    parts = F.split("spec", "/")
    prefixes = imports.select("spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("alias"))
    hit = prefixes.join(aliases, "alias").groupBy("spec").agg(F.max_by(F.struct("alias", "location"), F.struct(F.size(F.split("alias", "/")), F.length("alias"))).alias("a"))
    return hit.select("spec", F.concat(F.col("a.location"), F.substr("spec", F.length("a.alias") + 1)).alias("target"))


def peer_versions(versions: DataFrame, known: DataFrame) -> DataFrame:
    """J-18: (package, version, matched): the highest version of each package all of whose peers that are known are
    satisfied, one at least. ``versions``: package, version, peers map; ``known``: peer, peer_version."""
    spread = versions.select("package", "version", F.explode("peers").alias("peer", "range"))
    checked = spread.join(known, "peer").groupBy("package", "version").agg(F.bool_and(V.satisfies(F.col("peer_version"), F.col("range"))).alias("ok"), F.count("*").alias("matched"))
    return checked.where("ok").groupBy("package").agg(F.max_by(F.struct("version", "matched"), F.struct("matched", V.numbers(F.col("version")))).alias("v")).select("package", "v.*")


def version_by_peer(versions: DataFrame, known: DataFrame) -> DataFrame:
    """J-17: (peer_of, version, peer, specificity): for each known package the most specific range it satisfies."""
    spread = versions.select("package", "version", F.explode("peers").alias("peer", "range"))
    hit = spread.join(known, "peer").where(V.satisfies(F.col("peer_version"), F.col("range"))).withColumn("specificity", V.specificity(F.col("range")))
    return hit.groupBy("package").agg(F.max_by(F.struct("version", "peer", "specificity"), F.struct("specificity", V.numbers(F.col("version")), "peer")).alias("v")).select("package", "v.*")


def version_order(versions: DataFrame) -> DataFrame:
    """T-02: releases from the highest down, then prereleases."""
    w = Window.partitionBy("package").orderBy(V.is_prerelease(F.col("version")), F.desc(V.numbers(F.col("version"))), F.desc("version"))
    return versions.withColumn("rank", F.row_number().over(w))


def best_matches(files: DataFrame, candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """J-19: (file, version, similarity): the first candidate of the same package in search order with a similarity
    of 0.99, else the best one from ``least`` up, earlier ones winning ties.

    Fingerprints are structs f and g (normalized_hash, content_hash, signature, length); the join is on the package.
    """
    pairs = files.join(candidates, "package").withColumn("similarity", C.source_similarity(F.col("f"), F.col("g"))).where(F.col("similarity") >= least)
    exact = F.col("similarity") >= 0.99
    order = F.struct(~exact, F.when(exact, F.lit(0.0)).otherwise(-F.col("similarity")), "search_rank")
    return pairs.groupBy("file").agg(F.min_by(F.struct("version", "similarity"), order).alias("m")).select("file", "m.*")


def class_name_map(classes: DataFrame) -> DataFrame:
    """A-G09: (base, hashed): the sorted hashed names of each base name."""
    return classes.groupBy("base").agg(F.array_sort(F.collect_set("hashed")).alias("hashed"))


def resolve_classes(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """J-29: each name's first hashed name, or itself."""
    return names.join(mapping, names.name == mapping.base, "left").select("name", F.coalesce(F.try_element_at("hashed", F.lit(1)), F.col("name")).alias("resolved"))


def files_with_all(exports: DataFrame, wanted: DataFrame) -> DataFrame:
    """J-13: (package, file): the one file of a package that exports all wanted names, if there is exactly one."""
    need = wanted.groupBy("package").agg(F.count_distinct("name").alias("need"))
    held = exports.join(wanted, ["package", "name"]).groupBy("package", "file").agg(F.count_distinct("name").alias("held"))
    full = held.join(need, "package").where("held = need").groupBy("package").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    return full.where("n = 1").select("package", "file")


def merge_redirects(scraped: DataFrame, browsed: DataFrame) -> DataFrame:
    """J-21: scraped redirects, and the browser's from elsewhere."""
    return scraped.unionByName(browsed.join(scraped.select("from"), "from", "left_anti"))


def package_features(files: DataFrame) -> DataFrame:
    """A-G16, P-39: sets of literals, calls and numbers of each package (package, content), and their total length."""
    f = files.select("package", F.length("content").alias("n"), C.string_literals(F.col("content")).alias("s"), C.call_patterns(F.col("content")).alias("c"), C.number_literals(F.col("content")).alias("d"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return f.groupBy("package").agg(union("s").alias("strings"), union("c").alias("calls"), union("d").alias("numbers"), F.sum("n").alias("length"), F.count("*").alias("files"))


def version_cascade(deps: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """X-01, J-02, U-02: (name, version, confidence, source): each dependency's version from the first tier that
    knows one. Tiers (name, version, confidence) are tagged with their place and met in one aggregate and one join."""
    tagged = None
    for rank, (source, tier) in enumerate(tiers):
        own = tier.select("name", "version", "confidence", F.lit(source).alias("source"), F.lit(rank).alias("rank"))
        tagged = own if tagged is None else tagged.unionByName(own)
    best = tagged.where("version is not null").groupBy("name").agg(F.min_by(F.struct("version", "confidence", "source"), "rank").alias("v"))
    return deps.select("name").join(best, "name", "left").select("name", F.coalesce("v.version", F.lit("*")).alias("version"), F.coalesce("v.confidence", F.lit("unverified")).alias("confidence"), F.coalesce("v.source", F.lit("none")).alias("source"))


def package_json(deps: DataFrame, name: str) -> DataFrame:
    """N-01: one JSON document: exact versions as they are, others with a caret, private ones from the workspace, unknown as any."""
    said = F.when(F.col("is_private"), "workspace:*").when(F.col("version") == "*", "*").when(F.col("confidence") == "exact", F.col("version")).otherwise(F.concat(F.lit("^"), F.col("version")))
    entries = deps.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", said.alias("v"))))).alias("dependencies"))
    return entries.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(True).alias("private"), "dependencies")).alias("json"))


def scss_stub(names: DataFrame) -> DataFrame:
    """N-07: one stub text for undefined variables, sorted."""
    return names.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("$"), F.col("name"), F.lit(": unset !default;")))), "\n").alias("text"))
