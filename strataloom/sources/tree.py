"""Files of a directory tree as tables, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import format_group, ordered_globs

# Lockfiles and folders that are never indexed.
EXCLUDED = ["**", "!**/.git/**", "!**/node_modules/**", "!**/*.lock", "!**/package-lock.json", "!**/pnpm-lock.yaml", "!**/go.sum"]
MAX_BYTES = 1 << 20


def _relative(root: str):
    path = F.regexp_replace(F.regexp_extract("path", r"^(?:[a-z0-9]+:)?(/.*)$", 1), "^/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return path.substr(F.lit(len(base) + 1), F.length("path"))


def fingerprints(spark: SparkSession, root: str, repo: str, rules: list[str] | None = None) -> DataFrame:
    """(repo, path, fingerprint) of the files that ``read_tree`` would read, by size and modification time; nothing is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    rows = rows.select(_relative(root.rstrip("/")).alias("path"), F.concat_ws("-", "length", F.unix_micros("modificationTime")).alias("fingerprint"))
    return rows.where(format_group(F.col("path")).isNotNull() & ordered_globs(F.col("path"), rules or EXCLUDED)).select(F.lit(repo).alias("repo"), "path", "fingerprint")


def read_tree(spark: SparkSession, root: str, repo: str, rules: list[str] | None = None, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics) of a tree on any file system that Spark reads.

    files: repo, path (relative), hash, format_group, source, n_bytes. Only known extensions
    that the ordered globs keep are read; a file over ``max_bytes`` or that is not UTF-8 has
    an empty source, the hash of the empty text and a row in diagnostics (repo, path, message).
    """
    root = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.select(_relative(root).alias("path"), F.col("length").alias("n_bytes"), "content")
    rows = rows.where(format_group(F.col("path")).isNotNull() & ordered_globs(F.col("path"), rules or EXCLUDED))
    small, text = F.col("n_bytes") <= max_bytes, F.is_valid_utf8(F.col("content").cast("string"))
    good = small & F.coalesce(text, F.lit(False))
    source = F.when(good, F.col("content").cast("string")).otherwise("")
    files = rows.select(F.lit(repo).alias("repo"), "path", F.sha2(source, 256).alias("hash"), format_group(F.col("path")).alias("format_group"), source.alias("source"), "n_bytes")
    message = F.when(~small, "File is larger than the limit").otherwise("File is not UTF-8")
    return files, rows.where(~good).select(F.lit(repo).alias("repo"), "path", message.alias("message"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and CRLF; nested cells become JSON, nulls empty cells."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.option("header", "true").option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row; absent values are left out."""
    df.write.json(path)


def export_json_array(df: DataFrame, path: str, limit: int) -> None:
    """One JSON array of at most ``limit`` rows, for reports; more rows are an error."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: use JSON lines")
    with open(path, "w", encoding="utf-8") as f:
        f.write("[" + ",\n".join(rows) + "]\n")


def read_subset(spark: SparkSession, root: str, repo: str, paths: DataFrame, rules: list[str] | None = None, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """As ``read_tree``, only for the paths (path) of a table; a folder's path stands for all below it."""
    files, bad = read_tree(spark, root, repo, rules, max_bytes)
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keep = lambda df: df.withColumn("_p", F.explode(prefixes)).join(paths.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi").drop("_p").distinct()
    return keep(files), keep(bad)
