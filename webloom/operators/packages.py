"""Operators on a project's files and packages: which files belong to a package, where aliases lie, what a project uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import paths as T

# Folder names that are no packages, folders of a package's sources, and files that a rebuild needs.
PLAIN_FOLDERS = (
    "src", "lib", "dist", "build", "assets", "images", "styles", "types", "utils", "helpers", "components", "hooks", "api", "redux",
    "store", "services", "constants",
)
SOURCE_FOLDERS = ("src", "lib", "dist", "es", "esm")
BUILD_FOLDERS = ("node_modules", "dist", "build")
REQUIRED_FILES = ("package.json", "vite.config.ts", "index.html")
CODE_FILE = r"\.(tsx?|jsx?)$"


def package_files(files: DataFrame, packages: DataFrame) -> DataFrame:
    """J-04: (package, path): the ``files`` (path) of each of ``packages`` (name).

    A file belongs to the package whose folder under node_modules holds it, and to those whose bare
    name it shows: before a hash in the file's name, before a version in a folder's, or as a folder
    above one of sources. All of them are read out of the path, so the join is on equal names, not on a
    pattern for each package.
    """
    segs = F.split("path", r"[/\\]")
    folders = F.slice(segs, 2, F.greatest(F.size(segs) - 2, F.lit(0)))
    hashed = F.regexp_extract(F.element_at(segs, -1), r"(?i)^(.*)-[a-zA-Z0-9]{4,}\.m?js$", 1)
    versioned = F.flatten(F.transform(folders, lambda s: F.filter(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(F.substr(s, i).rlike(r"^-\d+\.\d+\.\d+"), F.substr(s, F.lit(1), i - 1))), lambda x: x.isNotNull())))
    above = F.filter(F.transform(folders, lambda s, i: F.when(F.lower(F.get(folders, i + 1)).isin(list(SOURCE_FOLDERS)), s)), lambda x: x.isNotNull())
    bare = F.when(F.size(segs) > 1, F.concat(F.array(hashed), F.filter(versioned, lambda x: x != ""), above)).otherwise(F.array().cast("array<string>"))
    named = F.when(F.lower("path").contains("node_modules/"), F.lower(T.package_of_path(F.col("path"))))
    keys = F.concat(F.transform(bare, lambda b: F.concat(F.lit("b:"), F.lower(b))), F.array(F.concat(F.lit("n:"), named)))
    spread = files.select("path", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (F.length(k) > 2)))).alias("key"))
    name = F.lower("name")
    wanted = packages.select(F.col("name").alias("package"), F.explode(F.array(F.concat(F.lit("n:"), name), F.concat(F.lit("b:"), F.regexp_replace(name, "^@[^/]+/", "")))).alias("key"))
    return spread.join(wanted, "key").select("package", "path").distinct()


def alias_locations(aliases: DataFrame, files: DataFrame) -> DataFrame:
    """J-26: (alias, package, location) of ``aliases`` (alias, package): where the first of ``files`` (path, ord) puts the package, or where
    packages lie by default."""
    package = F.regexp_extract("path", r"node_modules/(@[^/]+/[^/]+|[^/]+)", 1)
    found = files.withColumn("package", package).where("package <> ''").groupBy("package").agg(F.min_by(F.split_part("path", F.lit("/"), F.lit(1)), "ord").alias("bundle"))
    root = F.coalesce(F.concat(F.lit("./"), F.col("bundle"), F.lit("/node_modules/")), F.lit("./node_modules/"))
    return aliases.join(found, "package", "left").select("alias", "package", F.concat(root, F.col("package")).alias("location"))


def project_tests(files: DataFrame) -> DataFrame:
    """F-24: one row over a project's ``files`` (path, content): what it uses, whether it has been built, and what it lacks."""
    name = F.col("path")
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    present = F.collect_set(F.when(name.isin(list(REQUIRED_FILES)), name))
    missing = F.filter(F.array(*[F.lit(f) for f in REQUIRED_FILES]), lambda f: ~F.array_contains(present, f))
    return files.agg(
        has(name.rlike(r"\.(scss|sass)$") | F.coalesce(F.col("content").rlike(r"""import\s+['"][^'"]+\.scss['"]"""), F.lit(False))).alias("sass"),
        has(name.contains(".module.css") | name.contains(".module.scss")).alias("css_modules"), has(name == "tsconfig.json").alias("typescript"),
        has(name.startswith("_rebuilt/")).alias("built"), F.array_join(missing, ",").alias("missing"),
    )


def package_folders(files: DataFrame) -> DataFrame:
    """F-17: (folder, package) of the first-level folders of ``files`` (path): whether each looks like a package's, by its name and
    by code in it, in its src folder, or in any folder below it that is not for builds."""
    rows = files.where(F.col("path").contains("/")).select(F.split("path", "/").alias("s"))
    name, child, last = F.col("s")[0], F.col("s")[1], F.element_at("s", -1)
    code = last.rlike(CODE_FILE)
    direct = (F.size("s") == 2) & code & ~last.startswith(".")
    in_src = (F.size("s") == 3) & (child == "src") & code
    below = (F.size("s") > 2) & ~child.startswith(".") & ~child.isin(list(BUILD_FOLDERS))
    fits = name.rlike(r"(?i)^(@[a-z0-9-]+/)?[a-z][a-z0-9-]*$") & ~F.lower(name).isin(list(PLAIN_FOLDERS))
    return rows.groupBy(name.alias("folder")).agg(F.bool_or(fits & (direct | in_src | below)).alias("package"))


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int, cut) -> DataFrame:
    """G-09: (path, round): ``seeds`` (path) and all that they import over ``edges`` (src, dst), round by round until nothing is new."""
    seen = cut(seeds.select("path", F.lit(0).alias("round")).distinct())
    frontier = seen
    for k in range(1, max_rounds + 1):
        met = frontier.join(edges, frontier.path == edges.src).select(F.col("dst").alias("path")).distinct()
        frontier = cut(met.join(seen, "path", "left_anti").withColumn("round", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen
