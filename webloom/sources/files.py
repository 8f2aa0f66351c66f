"""Sources over folders of files: code, styles, bundles, manifests, fixtures and states.

All read through Spark's file readers, so paths of any file system work, files are listed and
read by executors, and name filters apply before a file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.sourcemaps import SCHEMA as MAP_SCHEMA

# Folders whose files are no sources of a project.
SKIPPED_FOLDERS = ("node_modules", "dist", "build")
CODE = "*.{js,jsx,ts,tsx,mjs,cjs}"
STYLES = "*.{css,scss,sass,less}"
FIXTURE = "id STRING, request STRUCT<method: STRING, path: STRING, pattern: STRING, query: MAP<STRING, STRING>>, response STRUCT<status: INT, body: STRING>, priority INT"


def relative_path(path: Column, root: str) -> Column:
    """A file's path below ``root``, wherever the reader's own scheme and host come from."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    base = root.split("://", 1)[1].split("/", 1)[-1] if "://" in root else root.removeprefix("file:")
    return F.regexp_replace(F.url_decode(F.replace(F.replace(bare, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))), rf"^/*{_quoted(base.strip('/'))}/+", "")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def scan_files(spark: SparkSession, root: str, names: str = "*", skip: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """S-09, S-10, S-12 to S-15: (path, bytes, content) of the files below ``root`` whose names match the glob ``names``.

    Folders named in ``skip`` and those that begin with a dot or an underscore are passed over. One
    row is one file; contents are read by executors, and only if the column is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    path = relative_path(F.col("path"), root)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    hidden = F.exists(folders, lambda f: f.isin(list(skip)) | f.startswith(".") | f.startswith("_"))
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.decode("content", "utf-8").alias("content")).where(~hidden)


def scan_json(spark: SparkSession, root: str, schema: str, names: str = "*.json") -> DataFrame:
    """(path, value) of the JSON files below ``root``, one row a file; a file that is no JSON gives null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return files.select(relative_path(F.col("path"), root).alias("path"), F.from_json(F.decode("content", "utf-8"), schema).alias("value"))


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """S-18: the fixtures of a captured site, one row a file; the readers pass over index files, which begin with an underscore."""
    return scan_json(spark, f"{root}/_server/fixtures", FIXTURE).select("path", "value.*")


def captured_sites(spark: SparkSession, root: str) -> DataFrame:
    """S-19: (site) of the folders below ``root`` that hold a folder of server data."""
    # The readers hide folders that begin with an underscore, so the file system itself is asked; one row is one site.
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(make(root)) if s.isDirectory()] if fs.exists(make(root)) else []
    return spark.createDataFrame([(n,) for n in names if fs.exists(make(f"{root}/{n}/_server"))], "site STRING")


def source_maps(spark: SparkSession, root: str) -> DataFrame:
    """S-05, S-06: (map_id, json) of the map files below ``root``, as the extraction operators take them."""
    files = scan_files(spark, root, "*.map", skip=())
    return files.select(F.col("path").alias("map_id"), F.col("content").alias("json"))


def class_maps(spark: SparkSession, root: str) -> DataFrame:
    """S-28: (path, module, name, hashed) of class-name maps: JSON objects of modules, each an object of hashed names by name."""
    rows = scan_json(spark, root, "MAP<STRING, MAP<STRING, STRING>>")
    return rows.select("path", F.explode("value").alias("module", "names")).select("path", "module", F.explode("names").alias("name", "hashed"))


def parsed_maps(maps: DataFrame) -> DataFrame:
    """S-04: ``maps`` (map_id, json) with their fields; a map that cannot be read has null fields."""
    return maps.select("map_id", F.from_json("json", MAP_SCHEMA).alias("m")).select("map_id", "m.*")
