"""Discovery of source files and their grouping by project."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import collapse_spaces, hash_text, script_kind
from tessella.operators.policy import glob_regex, ignored

EXTENSIONS = ("ts", "cts", "mts", "tsx")
_BUILT_IN = r"(^|/)(node_modules|dist|\.git)/|\.d\.[cm]?ts$|\.gen\.[^/]*$|\.generated\.[^/]*$"


def built_in_exclusion(path: Column) -> Column:
    """Dependencies, build output, declaration files and generated code."""
    return path.rlike(_BUILT_IN)


def analysable(path: Column) -> Column:
    return ~path.rlike(r"(^|/)node_modules/|\.d\.[cm]?ts$")


SOURCES = "file string, source string, modified_ms bigint, size bigint, script_kind string"


def _listed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, file, rel) of the files below root with a name that fits, without their content: the source prunes that column and opens no file."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")
    file = F.regexp_replace("path", "^file:", "")
    return raw.select("path", file.alias("file"), F.when(file.startswith(base), F.substring(file, len(base) + 1, 1 << 30)).otherwise(file).alias("rel"))


def scanned_paths(spark: SparkSession, root: str, paths: list[str] | None = None, ignore: list[str] | None = None, gitignore: list[str] | None = None) -> DataFrame:
    """(file) of every source file below root that is to be reported on.

    paths: folders and globs relative to root ("." by default), or files. gitignore
    holds the root ignore file's lines; it counts for files below root only.
    """
    listed = _listed(spark, root, "*.{" + ",".join(EXTENSIONS) + "}")
    rel, file, base = F.col("rel"), F.col("file"), root.rstrip("/") + "/"
    wanted = None
    for p in paths or ["."]:
        p = p.strip().removeprefix("./").rstrip("/")
        hit = F.lit(True) if p in ("", ".") else rel.rlike(glob_regex("/" + p)) | (file == p) | file.startswith(p + "/") | rel.startswith(p + "/") | (rel == p)
        wanted = hit if wanted is None else wanted | hit
    return listed.where(wanted & ~built_in_exclusion(rel) & ~ignored(rel, ignore or []) & ~(ignored(rel, gitignore or []) & file.startswith(base))).select("file")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """SOURCES of every source file below root, but for dependencies, build output and generated code.

    Paths are listed and filtered first, so that no body of a file that is left out
    is opened. The list of paths is on the driver, as any file index of Spark is.
    """
    kept = [r["path"] for r in _listed(spark, root, "*.{" + ",".join(EXTENSIONS) + "}").where(~built_in_exclusion(F.col("rel"))).select("path").toLocalIterator()]
    if not kept:
        return spark.createDataFrame([], SOURCES)
    escaped = ["".join("\\" + c if c in "*?[]{}\\" else c for c in p) for p in kept]
    raw = spark.read.format("binaryFile").load(escaped)
    return raw.select(F.regexp_replace("path", "^file:", "").alias("file"), F.decode("content", "utf-8").alias("source"), F.unix_millis("modificationTime").alias("modified_ms"), F.col("length").alias("size"), script_kind(F.col("path")).alias("script_kind"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "/"))).otherwise(F.array().cast("array<string>"))


def nearest_ancestor(files: DataFrame, folders: DataFrame, path: str = "file") -> DataFrame:
    """files with folder: the deepest of folders above each path, null if there is none. An as-of join on depth: exploded ancestors, one equi join, max_by."""
    rest = [c for c in files.columns if c != path]
    f = folders.select("folder", F.lit(True).alias("_is")).distinct()
    up = files.select(path, *rest, F.explode_outer(ancestors(F.col(path))).alias("_up"))
    hit = up.join(f, F.col("_up") == F.col("folder"), "left")
    return hit.groupBy(path, *rest).agg(F.max_by("folder", F.when(F.col("_is"), F.length("folder"))).alias("folder"))


def group_by_project(files: DataFrame, configs: DataFrame) -> DataFrame:
    """files with group_id: configs (folder, options_key) of the nearest config above, groups with equal options merged."""
    placed = nearest_ancestor(files, configs.select("folder"))
    merged = configs.groupBy("options_key").agg(F.min("folder").alias("group_id")).join(configs, "options_key").select(F.col("folder").alias("c_folder"), "group_id")
    return placed.join(merged, F.col("folder") == F.col("c_folder"), "left").drop("c_folder", "folder").withColumn("group_id", F.coalesce("group_id", F.lit("")))


def files_table(sources: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """The files fact table: scanned (file) says which may be reported; the rest is context."""
    cols = sources.columns
    out = sources.withColumn("ws_hash", hash_text(collapse_spaces(F.col("source"))))
    out = out if "group_id" in cols else out.withColumn("group_id", F.lit(""))
    out = out if "package_root" in cols else out.withColumn("package_root", F.lit(""))
    if scanned is None:
        out = out.withColumn("reportable", F.lit(True))
    else:
        out = out.join(scanned.select(F.col("file").alias("_s")).distinct(), F.col("file") == F.col("_s"), "left").withColumn("reportable", F.col("_s").isNotNull()).drop("_s")
    return out.where(analysable(F.col("file"))).select("group_id", "file", "source", "ws_hash", "reportable", "package_root")


def _named(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder, file) of the files below root with a name that fits, outside of dependencies and build output."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return _listed(spark, root, name).select("path", "file", folder.alias("folder")).where(~F.concat("folder", F.lit("/")).rlike(r"/(node_modules|dist|\.git)/"))


_TARGETS = ("target", "module", "moduleResolution", "jsx", "strict", "paths", "baseUrl", "lib", "types", "esModuleInterop")
CONFIGS = "folder string, options_key string, strict_null_checks boolean, no_unchecked_indexed_access boolean"


def parse_config(text: str) -> dict:
    """A compiler configuration with comments and trailing commas allowed; {} if it can't be read."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        found = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def extended(file: str, configs: dict[str, dict], seen: frozenset = frozenset()) -> dict:
    """The compiler options of a configuration on top of those of the ones it extends (relative paths; of several the last wins)."""
    own = configs.get(file, {})
    out: dict = {}
    above = own.get("extends", [])
    for name in above if isinstance(above, list) else [above]:
        if isinstance(name, str) and name.startswith((".", "/")):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(file), name))
            hit = next((p for p in (path, path + ".json", path + "/tsconfig.json") if p in configs), None)
            if hit is not None and hit not in seen:
                out |= extended(hit, configs, seen | {file})
    options = own.get("compilerOptions", {})
    return out | (options if isinstance(options, dict) else {})


def project_configs(spark: SparkSession, root: str, name: str = "tsconfig.json") -> DataFrame:
    """CONFIGS of every compiler configuration below root; configurations with equal keys make one group.

    Comments and trailing commas are allowed; one that can't be read counts as
    empty. Relative `extends` are followed through the JSON files named like
    configurations; packages are not. There is one configuration a project, so
    they are settled on the driver.
    """
    listed = _named(spark, root, "tsconfig*.json")
    paths = [r["path"] for r in listed.toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], CONFIGS)
    read = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:", "").alias("file"), "content")
    configs = {r["file"]: parse_config(bytes(r["content"]).decode("utf-8-sig", "replace")) for r in read.toLocalIterator()}
    rows = []
    for file in sorted(configs):
        if posixpath.basename(file) == name:
            o = extended(file, configs)
            strict = bool(o.get("strict", False))
            rows.append((posixpath.dirname(file), json.dumps({k: o.get(k) for k in _TARGETS}, sort_keys=True), bool(o.get("strictNullChecks", strict)), bool(o.get("noUncheckedIndexedAccess", False))))
    return spark.createDataFrame(rows, CONFIGS)


def place(sources: DataFrame, configs: DataFrame, packages: DataFrame) -> DataFrame:
    """sources with group_id (the merged group of the nearest configuration above) and package_root (the nearest of packages (folder)); texts stay out of the ancestor joins."""
    slim = group_by_project(sources.select("file").distinct(), configs.select("folder", "options_key"))
    roots = nearest_ancestor(slim.select("file"), packages).withColumnRenamed("folder", "package_root")
    both = slim.join(roots, "file").select(F.col("file").alias("_f"), "group_id", F.coalesce("package_root", F.lit("")).alias("package_root"))
    return sources.join(both, F.col("file") == F.col("_f"), "left").drop("_f")


def merged_options(configs: DataFrame) -> DataFrame:
    """group_id with the options of the group; the first folder's count."""
    return configs.groupBy("options_key").agg(F.min("folder").alias("group_id"), F.min_by("strict_null_checks", "folder").alias("strict_null_checks"), F.min_by("no_unchecked_indexed_access", "folder").alias("no_unchecked_indexed_access")).drop("options_key")


def packages(spark: SparkSession, root: str) -> DataFrame:
    return _named(spark, root, "package.json").select("folder").distinct()
