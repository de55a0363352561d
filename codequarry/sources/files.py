"""Source files: scan, language, class, bounded read, embedded scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_glob, normal_path

#: Extensions of each language. Fixed values.
LANGUAGES = {
    "python": ("py", "pyi"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "csharp": ("cs", "csx"),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "ruby": ("rb", "rake"),
    "html": ("html", "htm"),
    "razor": ("cshtml", "razor"),
}
#: Languages whose facts only a compiler has: they stay in the inventory with a status of their own.
COMPILED = ("razor",)
MAX_BYTES, MAX_LINES = 16 << 20, 4 << 20
#: Classes by precedence.
CLASSES = ("excluded", "vendor", "generated", "test")


def language(path: Column) -> Column:
    """The language of a path's extension in any case, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name, extensions in LANGUAGES.items():
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def file_class(path: Column, globs: dict[str, list[str]]) -> Column:
    """excluded before vendor before generated before test, else source."""
    out = F.lit("source")
    for name in reversed(CLASSES):
        out = F.when(any_glob(path, globs.get(name, [])), name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, globs: dict[str, list[str]] | None = None) -> DataFrame:
    """path, language, class, status, text of the files under ``root``.

    Excluded and unknown files never get their content read. Too large files and invalid UTF-8
    stay in the inventory with status ``failed`` and no text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumn("path", normal_path(F.regexp_replace("path", "^[a-z0-9]+:", "")))
    files = files.withColumns({"language": language(F.col("path")), "class": file_class(F.col("path"), globs or {})})
    files = files.where(F.col("language").isNotNull() & (F.col("class") != "excluded"))
    return bounded(files)


def bounded(files: DataFrame, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> DataFrame:
    """Turns ``content`` into ``text`` with a status: complete, or failed for size, lines or encoding."""
    text = F.when(F.octet_length("content") <= max_bytes, F.try_validate_utf8(F.col("content").cast("string")))
    out = files.withColumn("text", text)
    few = F.length(F.regexp_replace("text", "[^\n]", "")) < max_lines
    status = F.when(F.col("text").isNull() | ~few, "failed").otherwise("complete")
    if "language" in files.columns:
        status = F.when(F.col("language").isin(*COMPILED), "needs compiler").otherwise(status)
    out = out.withColumn("status", status)
    return out.withColumn("text", F.when(F.col("status") == "complete", F.col("text"))).drop("content")


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose path and content digest aren't in the cache of (path, digest): the rest needs no new run."""
    return files.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).join(cache.select("path", "digest"), ["path", "digest"], "left_anti")


_SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"


def embedded_scripts(pages: DataFrame, key: str = "url", markup: str = "html") -> DataFrame:
    """key, script_no (from 1), script of the inline scripts that aren't blank."""
    found = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(_SCRIPT), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("at", "script")).where(F.trim("script") != "").select(key, (F.col("at") + 1).alias("script_no"), "script")


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Each file with the config file in the nearest folder above, by equality on all its ancestors."""
    folders = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/"))
    up = files.select("path", F.explode(F.array_distinct(above)).alias("folder"))
    known = configs.select(F.col("path").alias("config"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    return files.join(up.join(known, "folder").groupBy("path").agg(F.max_by("config", F.length("folder")).alias("config")), "path", "left")


FACTS = "path string, kind string, name string, type string, sl int, sc int, el int, ec int"


def compiler_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts that a compiler's helper has written as Parquet: symbols with their types and places."""
    return spark.read.schema(FACTS).parquet(path)


def merged_results(fresh: DataFrame, cached: DataFrame, changed: DataFrame) -> DataFrame:
    """The findings of an incremental run: those of changed files, and the cached ones of all others that are still there (changed has path)."""
    return fresh.unionByName(cached.join(changed.select("path").distinct(), "path", "left_anti"))


def _glob(pattern: Column) -> Column:
    """A path glob as a regular expression, by built-in functions: ** spans folders, * and ? stay inside one."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\\\[\]])", r"\\$1")
    for a, b in ((r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        out = F.regexp_replace(out, a, b)
    return out


def ignore_rules(ignores: DataFrame) -> DataFrame:
    """folder, at, regex, negated of the lines of ignore files (path, text); comments and blank lines give none.

    A pattern with a slash before its end stands for one place under the file's folder, any other for
    all places below; what a pattern names takes everything inside with it, and ! takes it back.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = ignores.select(folder.alias("folder"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "line"))
    rows = rows.select("folder", "at", F.rtrim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    negated = F.col("line").startswith("!")
    body = F.regexp_replace(F.regexp_replace("line", "^!", ""), "/+$", "")
    anchored = F.instr(body, "/") > 0
    prefix = F.when(F.col("folder") == "", "").otherwise(F.concat(_glob(F.col("folder")), F.lit("/")))
    regex = F.concat(F.lit("^"), prefix, F.when(anchored, "").otherwise("(?:.*/)?"), _glob(F.regexp_replace(body, "^/+", "")), F.lit("(?:/.*)?$"))
    return rows.select("folder", "at", regex.alias("regex"), negated.alias("negated"))


def walked(files: DataFrame, ignores: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """The files, each path once, that no ignore file of a folder above ignores; explicit ones (path) always stay.

    The last pattern that fits decides, those of deeper folders after those above.
    """
    paths = files.dropDuplicates(["path"])
    folders = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/")))
    tried = paths.select("path", F.explode(above).alias("folder")).join(ignore_rules(ignores), "folder").where("path rlike regex")
    last = tried.groupBy("path").agg(F.max_by("negated", F.struct(F.length("folder"), "at")).alias("back")).where("not back").select("path")
    if explicit is not None:
        last = last.join(explicit.select("path"), "path", "left_anti")
    return paths.join(last, "path", "left_anti")
