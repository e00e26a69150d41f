"""Line totals, folder rollups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMMENT = r"^\s*(//|#(?!include|define|if|endif|else|pragma|undef|line|!)|/\*|\*|<!--)"


def line_rows(texts: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, n, blank, comment) with one row per line; a final line end starts no further line.

    An empty text has no lines, a null one neither. Comment lines are told by how they begin.
    """
    body = F.regexp_replace(source, r"\r\n?", "\n")
    parts = F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1)
    rows = texts.where(F.length(source) > 0).select(*keys, F.posexplode(parts).alias("n", "line"))
    return rows.select(*keys, (F.col("n") + 1).alias("n"), F.col("line").rlike(r"^\s*$").alias("blank"), F.col("line").rlike(_COMMENT).alias("comment"))


def line_totals(lines: DataFrame, keys: list[str], test: str) -> DataFrame:
    """Counts over the three flags blank, comment and test in one pass; ``test`` is a column of keys."""
    n = lambda c: F.count_if(c).alias
    b, c, t = F.col("blank"), F.col("comment"), F.col(test)
    return lines.groupBy(*keys).agg(
        F.count("*").alias("lines"), n(b)("blank"), n(c & ~b)("comment"), n(~b & ~c)("code"),
        n(t)("test_lines"), n(t & b)("test_blank"), n(t & c & ~b)("test_comment"), n(t & ~b & ~c)("test_code"),
    )


def text_totals(texts: DataFrame, keys: list[str], source: str, test: str) -> DataFrame:
    """As ``line_totals`` over ``line_rows``, but lines are counted within each text: no row a line is made."""
    body = F.regexp_replace(F.regexp_replace(source, r"\r\n?", "\n"), r"\n\z", "")
    t = texts.where(F.length(source) > 0).select(*keys, F.col(test).alias("_t"), F.split(body, "\n", -1).alias("_l"))
    blank = lambda x: x.rlike(r"^\s*$")
    t = t.select(*keys, "_t", F.size("_l").alias("n"), F.size(F.filter("_l", blank)).alias("b"), F.size(F.filter("_l", lambda x: x.rlike(_COMMENT) & ~blank(x))).alias("c"))
    code = F.col("n") - F.col("b") - F.col("c")
    total = lambda v: F.sum(v.cast("long"))
    of_tests = lambda v: F.sum(F.when(F.col("_t"), v).otherwise(0).cast("long"))
    return t.groupBy(*keys).agg(
        total(F.col("n")).alias("lines"), total(F.col("b")).alias("blank"), total(F.col("c")).alias("comment"), total(code).alias("code"),
        of_tests(F.col("n")).alias("test_lines"), of_tests(F.col("b")).alias("test_blank"), of_tests(F.col("c")).alias("test_comment"), of_tests(code).alias("test_code"),
    )


def folder_rollup(files: DataFrame, keys: list[str], path: str, value: str) -> DataFrame:
    """(keys, folder, value, n_files): every ancestor folder sums its files; '' is the root.

    Each path is exploded into its prefixes, so the depth is open; a repeated path counts its largest value.
    """
    one = files.groupBy(*keys, path).agg(F.max(value).alias(value))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    out = one.select(*keys, F.explode(prefixes).alias("folder"), value)
    return out.groupBy(*keys, "folder").agg(F.sum(value).alias(value), F.count("*").alias("n_files"))


def tree_top(files: DataFrame, keys: list[str], path: str, value: str, limit: int) -> DataFrame:
    """(keys, entry, folder, value, chosen): the ``limit`` largest files and folders together, and the folders above them.

    Ties go by key and path. Folders above a chosen entry come without being chosen; all totals are those of
    the whole tree. The root counts for no entry.
    """
    one = files.groupBy(*keys, path).agg(F.max(value).alias(value))
    folders = folder_rollup(one, keys, path, value).where("folder <> ''").select(*keys, F.col("folder").alias("entry"), F.lit(True).alias("folder"), F.col(value).cast("long").alias(value))
    every = folders.unionByName(one.select(*keys, F.col(path).alias("entry"), F.lit(False).alias("folder"), F.col(value).cast("long").alias(value)))
    top = every.orderBy(F.desc(value), *keys, "entry").limit(limit)
    parts = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = top.where(F.size(parts) > 1).select(*keys, F.explode(above).alias("entry")).distinct()
    up = up.join(top.where("folder").select(*keys, "entry"), [*keys, "entry"], "left_anti")
    rest = folders.join(F.broadcast(up), [*keys, "entry"], "left_semi")  # at most the limit times the depth
    return top.withColumn("chosen", F.lit(True)).unionByName(rest.withColumn("chosen", F.lit(False)))
