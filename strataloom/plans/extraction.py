"""Queries over what the texts themselves hold: declarations, imports, calls, comments, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.extract import extracted
from strataloom.extract.lex import extension_language
from strataloom.extract.tables import kind_of
from strataloom.functions import text as X
from strataloom.operators import callgraph, graph, intervals, units
from strataloom.runtime import cut
from strataloom.sources import current_files, load


def _files(spark, d) -> DataFrame:
    """Current files with the language of their extension and the key of their text in it."""
    f = current_files(load(spark, d, "files"), ["hash", "description", "source_mode"]).withColumn("language", extension_language(F.col("path")))
    return f.where("hash IS NOT NULL AND language IS NOT NULL").withColumn("key", F.concat_ws(":", "hash", "language"))


def _rows(spark, d) -> DataFrame:
    """Extracted rows of all current texts, each text parsed once for a language."""
    need = _files(spark, d).select("key", "hash", "language").distinct()
    s = load(spark, d, "sources").select(F.col("hash").alias("of"), "source")
    return extracted(need.join(s, need.hash == s.of).select("key", "language", "source"), "key")


def _of(spark, d, rows: DataFrame, what: str, *columns: str) -> DataFrame:
    """Rows of a kind by file: repo, path, language and the columns."""
    return _files(spark, d).select("repo", "path", "language", "key").join(kind_of(rows, what).select("key", *columns), "key").drop("key")


def g2_callables(spark, d):
    """Every stored callable with a name, and whether the texts show it at its lines with its signature."""
    got = _of(spark, d, _rows(spark, d), "declaration", "kind", "name", "start_line", "end_line", "signature").where(F.col("kind").isin(callgraph.CALLABLE))
    got = got.groupBy("repo", "path", "name", "start_line", "end_line").agg(F.collect_set("signature").alias("signatures"))
    c = load(spark, d, "callables").where("name IS NOT NULL").select("unit_id", "repo", "path", "name", "start_line", "end_line", "signature").distinct()
    at = c.join(got, ["repo", "path", "name", "start_line", "end_line"], "left")
    return at.select("unit_id", F.col("signatures").isNotNull().alias("found"), (F.col("signature").isNull() | F.coalesce(F.array_contains("signatures", F.col("signature")), F.lit(False))).alias("same_signature"))


def g4_declarations(spark, d):
    """Stored classes, implementations and callables with a name, and whether the texts show them."""
    got = _of(spark, d, _rows(spark, d), "declaration", "kind", "name", "start_line", "end_line").distinct().withColumn("found", F.lit(True))
    s = load(spark, d, "symbols").where(F.col("name").isNotNull() & F.col("kind").isin("class", "impl", "function", "method", "constructor")).select("repo", "path", "id", "kind", "name", "start_line", "end_line").distinct()
    return s.join(got.drop("language"), ["repo", "path", "kind", "name", "start_line", "end_line"], "left").select("repo", "path", "id", F.coalesce("found", F.lit(False)).alias("found"))


def g9_headings(spark, d):
    """Stored headings with a name, and whether the texts show them with their level."""
    got = _of(spark, d, _rows(spark, d), "declaration", "kind", "name", "start_line", "heading_level").where("kind = 'heading'").select("repo", "path", "name", "start_line", "heading_level").distinct().withColumn("found", F.lit(True))
    s = load(spark, d, "symbols").where("kind = 'heading' AND name IS NOT NULL").select("repo", "path", "id", "name", "start_line", "heading_level").distinct()
    return s.join(got, ["repo", "path", "name", "start_line", "heading_level"], "left").select("repo", "path", "id", F.coalesce("found", F.lit(False)).alias("found"))


def g12_keys(spark, d):
    """Stored keys of configuration files with a name, and whether the texts show them."""
    got = _of(spark, d, _rows(spark, d), "declaration", "kind", "name", "start_line").where("kind = 'item'").select("repo", "path", "name", "start_line").distinct().withColumn("found", F.lit(True))
    s = load(spark, d, "symbols").where("kind = 'item' AND name IS NOT NULL").select("repo", "path", "id", "name", "start_line").distinct()
    return s.join(got, ["repo", "path", "name", "start_line"], "left").select("repo", "path", "id", F.coalesce("found", F.lit(False)).alias("found"))


def g6_imports(spark, d):
    """What every file imports."""
    return _of(spark, d, _rows(spark, d), "import", "target", "name", "alias", "wildcard").distinct()


def g7_calls(spark, d):
    """Calls by owner: the innermost callable that holds them."""
    return _of(spark, d, _rows(spark, d), "call", "parent_id", "name", "target").select("repo", "path", F.col("parent_id").alias("owner"), "name", F.col("target").alias("receiver")).distinct()


def g10_chunks(spark, d):
    """Chunks of Markdown and configuration texts: none exceeds 8,192 bytes or 120 lines."""
    c = _of(spark, d, _rows(spark, d), "chunk", "id", "scope", "text", "start_line", "end_line")
    lines = F.size(F.split("text", "\n", -1))
    return c.select("repo", "path", "id", F.size("scope").alias("depth"), "start_line", "end_line", F.octet_length("text").alias("n_bytes"), lines.alias("n_lines"), ((F.octet_length("text") <= 8192) & (lines <= 120)).alias("fits"))


def g14_descriptions(spark, d):
    """Declarations with the documentation that stands above or within them."""
    return _of(spark, d, _rows(spark, d), "declaration", "id", "qualified_name", "description").where("description <> ''")


def g15_spans(spark, d):
    """Bytes of comments and inline tests by file."""
    rows = _rows(spark, d)
    both = _of(spark, d, rows, "comment", "start_byte", "end_byte").withColumn("category", F.lit("comment")).unionByName(_of(spark, d, rows, "test", "start_byte", "end_byte").withColumn("category", F.lit("test")))
    m = intervals.merge_ranges(both, ["repo", "path", "category"], "start_byte", "end_byte", touching=0)
    return m.groupBy("repo", "path", "category").agg(F.count("*").alias("spans"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"))


def g17_faults(spark, d):
    """Messages about texts that could not be read in full."""
    return _of(spark, d, _rows(spark, d), "fault", "id", "start_line", "text").withColumnRenamed("text", "message")


def g19_units(spark, d):
    """Search units of all current files: callables, described declarations and chunks, with their identities."""
    rows = cut(_rows(spark, d))
    decl = _of(spark, d, rows, "declaration", "id", "kind", "name", "qualified_name", "signature", "description", "start_line", "end_line", "start_byte", "text")
    return units.assembled(decl, _of(spark, d, rows, "chunk", "id", "scope", "text", "start_line", "end_line", "start_byte"))


def _graph(spark, d) -> DataFrame:
    rows = cut(_rows(spark, d))
    decls = _of(spark, d, rows, "declaration", "id", "parent_id", "kind", "name", "scope", "attributes", "signature")
    return callgraph.resolved_calls(decls, _of(spark, d, rows, "call", "parent_id", "name", "target"), _of(spark, d, rows, "import", "target", "name", "alias", "wildcard"))


def j13_resolved(spark, d):
    """Call edges resolved by scopes, receivers and imports."""
    return _graph(spark, d)


def j14_references(spark, d):
    """References of declarations to others, resolved by the file and its imports."""
    rows = cut(_rows(spark, d))
    decls = _of(spark, d, rows, "declaration", "id", "parent_id", "name")
    return callgraph.resolved_references(decls, _of(spark, d, rows, "use", "parent_id", "name"), _of(spark, d, rows, "import", "target", "name", "alias", "wildcard"))


def g8_uses(spark, d):
    """Uses of what a text declares at its top or imports, by the innermost declaration around them."""
    return _of(spark, d, _rows(spark, d), "use", "parent_id", "name", "start_line").select("repo", "path", F.col("parent_id").alias("owner"), "name", "start_line").distinct()


def j15_imported(spark, d):
    """Files that an import may mean, of the same repository."""
    i = _of(spark, d, _rows(spark, d), "import", "target", "name", "alias", "wildcard")
    files = callgraph.file_keys(_files(spark, d).select("repo", "path", "language")).select("repo", "key", F.col("path").alias("imported"))
    return callgraph.import_keys(i).join(files, ["repo", "key"]).where("path <> imported").select("repo", "path", "target", "imported").distinct()


def r8_cycles(spark, d):
    """Files on a circle of imports."""
    return callgraph.import_cycles(j15_imported(spark, d).select("repo", F.col("path").alias("src_path"), F.col("imported").alias("dst_path")))


def r2_related(spark, d):
    """Callers within one call and callees within two of the callables of the largest folder 'core', by first visit."""
    e = cut(_graph(spark, d))
    node = lambda side: F.concat_ws("#", "repo", f"{side}_path", f"{side}_id")
    e = e.select(node("src").alias("src"), node("dst").alias("dst"), F.col("src_path"))
    seeds = e.where(F.col("src_path").contains("core/")).select(F.col("src").alias("id"))
    down = graph.reach(e, seeds, 2).withColumn("side", F.lit("callees"))
    up = graph.reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, 1).withColumn("side", F.lit("callers"))
    return down.unionByName(up).where("depth > 0").select("id", "side", "depth")


def g5_prose(spark, d):
    """Descriptions of callables without comment marks."""
    c = load(spark, d, "callables").where("description IS NOT NULL").select("unit_id", "description").distinct()
    return c.select("unit_id", X.comment_prose(F.col("description")).alias("prose"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0].islower() and k.split("_")[0][1:].isdigit()}

ORACLES = {
    "g2_callables": "SELECT DISTINCT unit_id, true AS found, true AS same_signature FROM callables WHERE name IS NOT NULL",
    "g4_declarations": "SELECT DISTINCT repo, path, id, true AS found FROM symbols WHERE name IS NOT NULL AND kind IN ('class', 'impl', 'function', 'method', 'constructor')",
    "g9_headings": "SELECT DISTINCT repo, path, id, true AS found FROM symbols WHERE name IS NOT NULL AND kind = 'heading'",
    "g12_keys": "SELECT DISTINCT repo, path, id, true AS found FROM symbols WHERE name IS NOT NULL AND kind = 'item'",
}
