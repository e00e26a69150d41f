"""Queries over files, symbols, callables and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import text as X
from strataloom.operators import calls, freshness, graph, intervals, lines, outline, sections, snapshots
from strataloom.sources import current_files, load

ROOTS = ["src/**", "lib/**", "!**/*_pb2.py", "!**/{gen,generated}/**"]


def _current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_files(load(spark, d, "files"), list(columns))


def s8_current_files(spark, d):
    """The current row of every file."""
    return _current(spark, d, "hash", "language", "format_group", "source_mode", "parser_version")


def s10_current_structures(spark, d):
    """Current structures by parser version and language."""
    return _current(spark, d, "parser_version", "structure_hash", "language").where("structure_hash IS NOT NULL").groupBy("parser_version", "language").agg(F.count("*").alias("n_files"))


def s11_contents(spark, d):
    """Current files with the size of their stored text and whether its hash agrees."""
    s = load(spark, d, "sources").select(F.col("hash").alias("of"), F.octet_length("source").alias("n_bytes"), (F.sha2("source", 256) == F.col("hash")).alias("agrees"))
    f = _current(spark, d, "hash")
    return f.join(s, f.hash == s.of, "left").select("repo", "path", "n_bytes", "agrees")


def f2_globs(spark, d):
    """Files selected by ordered globs: the last matching rule decides."""
    return _current(spark, d, "language").where(X.ordered_globs(F.col("path"), ROOTS)).select("repo", "path")


def f3_config_globs(spark, d):
    """Files selected by configuration globs, whose star crosses folders."""
    return _current(spark, d, "language").where(X.ordered_globs(F.col("path"), ["*.py", "!tests/*"], True)).select("repo", "path")


def f4_format_groups(spark, d):
    """Files by the format group of their extension."""
    return _current(spark, d, "language").groupBy(X.format_group(F.col("path")).alias("format_group")).agg(F.count("*").alias("n_files"))


def f6_source_match(spark, d):
    """Callables whose name or source matches a pattern."""
    c = load(spark, d, "callables").where(F.col("name").rlike("(?i)^(load|fetch)") | F.col("source").rlike(r"\.(push|append)\("))
    return c.select("unit_id", "language", "name").distinct()


def f12_kinds(spark, d):
    """Symbols by group of kinds."""
    group = F.when(F.col("kind").isin("function", "method", "constructor", "generator"), "callable").when(F.col("kind").isin("class", "struct", "interface", "trait", "enum", "impl", "module", "namespace"), "container").otherwise("other")
    return load(spark, d, "symbols").select("repo", "path", "id", "language", "kind").distinct().groupBy("language", group.alias("kind_group")).agg(F.count("*").alias("n_symbols"))


def f13_private(spark, d):
    """Symbols that their language keeps private, by themselves."""
    first = F.substring("name", 1, 1)
    private = (
        F.when(F.col("language") == "python", F.col("name").startswith("_") & ~F.col("name").rlike("^__.*__$"))
        .when(F.col("language") == "go", first != F.upper(first))
        .when(F.col("language") == "rust", ~F.coalesce(F.col("signature").startswith("pub"), F.lit(False)))
        .otherwise(F.array_contains("attributes", "private"))
    )
    s = load(spark, d, "symbols").where("name IS NOT NULL").select("repo", "path", "id", "language", "name", "signature", "attributes").distinct()
    return s.where(private).select("repo", "path", "id", "name")


def f17_under(spark, d):
    """Files below a folder, by whole path components."""
    return _current(spark, d, "language").where(X.under(F.col("path"), "src/core")).select("repo", "path")


def f18_uncommitted(spark, d):
    """Callables of files of the working tree."""
    f = _current(spark, d, "source_mode").where("source_mode = 'working-tree'").select("repo", "path")
    return load(spark, d, "callables").select("unit_id", "repo", "path").distinct().join(f, ["repo", "path"], "left_semi").select("unit_id")


def g16_tests(spark, d):
    """Files by whether their path says that they are tests."""
    return _current(spark, d, "language").groupBy("language", X.is_test_path(F.col("path")).alias("test")).agg(F.count("*").alias("n_files"))


def g3_inputs(spark, d):
    """Length of the text that a callable is embedded by."""
    text = F.concat_ws("\n", "language", "kind", "qualified_name", "signature", F.nullif(F.trim("description"), F.lit("")), "source")
    # hashed before repeats are dropped, so no text is shuffled
    return load(spark, d, "callables").select("unit_id", F.sha2(text, 256).alias("input_hash")).distinct()


def j7_declarations(spark, d):
    """For every callable its declaration: same file and name, overlapping lines, nearest start, then column and id."""
    c = load(spark, d, "callables").select("unit_id", "repo", "path", "name", "start_line", "end_line", "start_column").distinct().alias("c")
    s = load(spark, d, "symbols").select("repo", "path", "name", "id", "start_line", "end_line", "start_column").distinct().alias("s")
    on = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in ("repo", "path", "name")]
    both = c.join(s, on[0] & on[1] & on[2] & (F.col("s.start_line") <= F.col("c.end_line")) & (F.col("s.end_line") >= F.col("c.start_line")))
    best = F.min(F.struct(F.abs(F.col("s.start_line") - F.col("c.start_line")).alias("l"), F.abs(F.col("s.start_column") - F.col("c.start_column")).alias("k"), F.col("s.id").alias("id")))
    return both.groupBy("c.unit_id").agg(best.alias("b")).select("unit_id", F.col("b.id").alias("symbol_id"))


def j9_headings(spark, d):
    """For every Markdown section the last heading at or before its first line: one window over both, no join."""
    none = F.lit(None)
    m = load(spark, d, "markdown_chunks").select("repo", "path", F.col("start_line").alias("at"), "unit_id", none.cast("int").alias("id"), none.cast("string").alias("name")).distinct()
    h = load(spark, d, "symbols").where("heading_level IS NOT NULL").select("repo", "path", F.col("start_line").alias("at"), none.cast("long").alias("unit_id"), "id", "name").distinct()
    order = Window.partitionBy("repo", "path").orderBy("at", F.col("unit_id").isNotNull(), "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("unit_id").isNull(), F.struct("id", "name")), True).over(order)
    both = h.unionByName(m).withColumn("b", last).where("unit_id IS NOT NULL AND b IS NOT NULL")
    return both.select("unit_id", F.col("b.id").alias("symbol_id"), F.col("b.name").alias("title"))


def j11_vocabulary(spark, d):
    """Normalised names with how many symbols and repositories have them."""
    s = load(spark, d, "symbols").where("name IS NOT NULL").select("repo", "path", "id", X.symbol_words(F.col("name")).alias("words")).distinct()
    return s.groupBy("words").agg(F.count("*").alias("n_symbols"), F.count_distinct("repo").alias("n_repos"))


def j13_calls(spark, d):
    """Call edges with one possible target."""
    return calls.call_edges(load(spark, d, "callables"))


def r2_callees(spark, d):
    """Callables within three calls of the constructors, by first visit."""
    seeds = load(spark, d, "callables").where("kind = 'method' OR name = '__init__'").select(F.col("unit_id").alias("id"))
    return graph.reach(calls.call_edges(load(spark, d, "callables")), seeds, 3)


def r1_call_groups(spark, d):
    """Connected components of the call graph."""
    e = calls.call_edges(load(spark, d, "callables")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.components(e).select(F.col("id").alias("unit_id"), "component")


def r3_ancestors(spark, d):
    """Symbols that match a name pattern, and all their ancestors."""
    s = load(spark, d, "symbols")
    return outline.closure(s, s.where(F.col("name").rlike("^(load|fetch)")), ["repo", "path"])


def _lines(spark, d) -> DataFrame:
    s = load(spark, d, "sources").select(F.col("hash").alias("of"), "source")
    f = _current(spark, d, "hash", "language")
    return f.join(s, f.hash == s.of).select("repo", "path", "language", X.is_test_path(F.col("path")).alias("test"), "source")


def a1_line_totals(spark, d):
    """Eight line counts by language: blank, comment, code, and those of tests."""
    return lines.text_totals(_lines(spark, d), ["language"], "source", "test")


def a4_folders(spark, d):
    """Lines and files below every folder of every repository."""
    n = _lines(spark, d).select("repo", "path", F.size(F.split(F.regexp_replace(F.regexp_replace("source", r"\r\n?", "\n"), r"\n\z", ""), "\n", -1)).alias("lines"))
    return lines.folder_rollup(n, ["repo"], "path", "lines")


def a6_covered(spark, d):
    """Lines that the callables of a file cover together."""
    end = X.inclusive_end(F.col("start_line"), F.col("end_line"), F.col("end_column"))
    c = load(spark, d, "callables").select("repo", "path", "start_line", end.alias("last_line"))
    return intervals.covered_lines(c, ["repo", "path"], "start_line", "last_line")


def w1_occurrences(spark, d):
    """Identity of every symbol: its occurrence among equal qualified names, and the hash over both."""
    s = load(spark, d, "symbols").where("qualified_name IS NOT NULL").select("repo", "path", "id", "qualified_name", "kind", "start_byte").distinct()
    s = sections.occurrences(s, ["repo", "path"], "qualified_name", ["start_byte", "id"])
    return s.select("repo", "path", "id", "occurrence", F.sha2(F.concat_ws("|", "repo", "path", "qualified_name", "kind", "occurrence"), 256).alias("identity"))


def w2_sections(spark, d):
    """Where the body and the section of every heading end."""
    h = load(spark, d, "symbols").where("heading_level IS NOT NULL").select("repo", "path", "id", "start_line", "heading_level").distinct()
    last = load(spark, d, "symbols").groupBy("repo", "path").agg(F.max("end_line").alias("last"))
    h = h.join(last, ["repo", "path"])
    return sections.section_ends(h, ["repo", "path"], "start_line", "heading_level", "last").select("repo", "path", "id", "body_end", "section_end")


def w9_first_matches(spark, d):
    """The first 40 matching symbols in path and source order: a budget over files."""
    s = load(spark, d, "symbols").where(F.col("name").rlike("^merge")).select("repo", "path", "id", "start_byte", "name").distinct()
    return s.orderBy("repo", "path", "start_byte", "id").limit(40).select("repo", "path", "id", "name")


def x6_distances(spark, d):
    """Distance of every file to the one before it in its repository."""
    f = _current(spark, d, "language").withColumn("before", F.lag("path").over(Window.partitionBy("repo").orderBy("path"))).where("before IS NOT NULL")
    return f.select("repo", "path", X.path_distance(F.col("path"), F.col("before")).alias("distance"))


def x8_slugs(spark, d):
    """Slugs of headings."""
    return load(spark, d, "symbols").where("heading_level IS NOT NULL AND name IS NOT NULL").select(F.col("name").alias("title"), X.slug(F.col("name")).alias("slug")).distinct()


def x11_concise(spark, d):
    """Descriptions of callables on one line of at most 60 characters."""
    c = load(spark, d, "callables").where("description IS NOT NULL").select("unit_id", "description").distinct()
    return c.select("unit_id", X.concise(F.col("description"), 60).alias("summary"))


def x14_labels(spark, d):
    """Location labels of callables."""
    end = X.inclusive_end(F.col("start_line"), F.col("end_line"), F.col("end_column"))
    return load(spark, d, "callables").select("unit_id", X.location(F.col("path"), F.col("start_line"), end, F.col("name")).alias("label")).distinct()


def a12_status(spark, d):
    """Files by language: all, described, from the working tree, without structure."""
    return _current(spark, d, "language", "description", "source_mode", "structure_hash").groupBy("language").agg(
        F.count("*").alias("n_files"), F.count("description").alias("described"),
        F.count_if(F.col("source_mode") == "working-tree").alias("uncommitted"), F.count_if(F.col("structure_hash").isNull()).alias("unparsed"),
    )


def a13_errors(spark, d):
    """Saved messages of current files by code."""
    e = load(spark, d, "diagnostics").select("repo", "path", "ordinal", "code", "message").distinct()
    return e.join(_current(spark, d, "hash").select("repo", "path"), ["repo", "path"], "left_semi").groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("repo").alias("n_repos"))


def u4_reindexed(spark, d):
    """What changed in files that were indexed again: oldest against latest row."""
    f = load(spark, d, "files")
    old = f.groupBy("repo", "path").agg(F.min(F.struct("indexed_at", "hash")).alias("r"), F.count_distinct("indexed_at").alias("n")).where("n > 1").select("repo", "path", F.col("r.hash").alias("hash"))
    new = _current(spark, d, "hash").join(old.select("repo", "path"), ["repo", "path"], "left_semi")
    return snapshots.changes(old, new, ["repo", "path"], "hash")


def k2_reconciled(spark, d):
    """Ids of all callables' identities, where every other one is known already."""
    ident = F.concat_ws("|", "repo", "path", "qualified_name", "start_line", "kind")
    c = load(spark, d, "callables").select("unit_id", ident.alias("identity")).distinct()
    old = c.where("unit_id % 2 = 0").groupBy("identity").agg(F.min("unit_id").alias("unit_id"))
    return snapshots.reconcile_ids(old, c, "identity", "unit_id")


def a17_freshness(spark, d):
    """Lines that files indexed again have kept since their oldest version."""
    f = load(spark, d, "files")
    old = f.groupBy("repo", "path").agg(F.min(F.struct("indexed_at", "hash")).alias("r"), F.count_distinct("indexed_at").alias("n")).where("n > 1")
    s = load(spark, d, "sources")
    old = old.join(s.select(F.col("hash").alias("h"), F.col("source").alias("was")), F.col("r.hash") == F.col("h"), "left").select("repo", "path", "was")
    new = _current(spark, d, "hash").join(s.withColumnRenamed("source", "now"), "hash", "left").select("repo", "path", "now")
    return freshness.freshness(old.join(new, ["repo", "path"]), ["repo", "path"], "was", "now")


def a19_digest(spark, d):
    """A digest of the current files in canonical order."""
    return snapshots.table_digest(_current(spark, d, "hash", "language"), ["repo", "path", "hash", "language"])


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0].islower() and k.split("_")[0][1:].isdigit()}

_CUR = "cur AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC) = 1)"
_ENDS = "greatest(coalesce(CASE WHEN end_column = 1 THEN end_line - 1 ELSE end_line END, start_line), start_line)"
_TEST = r"regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|_test\.(py|go|rs|c)$|\.(test|spec)\.[cm]?[jt]sx?$|Tests?\.java$')"
_EXT = r"lower(regexp_extract(path, '[^/]\.([A-Za-z0-9]+)$', 1))"
_WORDS = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'),
 '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')))"""
_BODY = r"regexp_replace(replace(replace(source, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\z', '')"
_CALLS = r"""c AS (SELECT DISTINCT unit_id, repo, name, source FROM callables), one AS (SELECT repo, name, min(unit_id) AS dst FROM c WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT unit_id) = 1),
 e AS (SELECT DISTINCT unit_id AS src, dst FROM (SELECT unit_id, repo, unnest(list_distinct(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS name FROM c) s JOIN one USING (repo, name))"""

ORACLES = {
    "a19_digest": f"""WITH {_CUR}, r AS (SELECT sha256(concat_ws(chr(31), repo, path, coalesce(hash, chr(0)), coalesce(language, chr(0)))) AS h FROM cur), b AS (SELECT substr(h, 1, 4) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(b || d, '' ORDER BY b)) AS digest FROM b""",
    "s8_current_files": f"WITH {_CUR} SELECT repo, path, hash, language, format_group, source_mode, parser_version FROM cur",
    "s10_current_structures": f"WITH {_CUR} SELECT parser_version, language, count(*) AS n_files FROM cur WHERE structure_hash IS NOT NULL GROUP BY 1, 2",
    "s11_contents": f"WITH {_CUR} SELECT repo, path, CAST(strlen(source) AS INTEGER) AS n_bytes, sha256(source) = s.hash AS agrees FROM cur LEFT JOIN sources s ON cur.hash = s.hash",
    "f2_globs": f"WITH {_CUR} SELECT repo, path FROM cur WHERE (path LIKE 'src/%' OR path LIKE 'lib/%') AND NOT path LIKE '%\\_pb2.py' ESCAPE '\\' AND NOT regexp_matches(path, '^(.*/)?(gen|generated)/')",
    "f3_config_globs": f"WITH {_CUR} SELECT repo, path FROM cur WHERE path LIKE '%.py' AND NOT path LIKE 'tests/%'",
    "f4_format_groups": f"""WITH {_CUR} SELECT CASE WHEN e IN ('ts','mts','cts','tsx','js','mjs','cjs','jsx','py','pyi','rs','go','java','c','h','sh','bash') THEN 'code' WHEN e IN ('md','markdown') THEN 'docs'
 WHEN e IN ('json','tf','tfvars','yaml','yml','toml') THEN 'config' WHEN e IN ('xml','html','htm','css') THEN 'markup' END AS format_group, count(*) AS n_files FROM (SELECT {_EXT} AS e FROM cur) GROUP BY 1""",
    "f6_source_match": r"SELECT DISTINCT unit_id, language, name FROM callables WHERE regexp_matches(name, '(?i)^(load|fetch)') OR regexp_matches(source, '\.(push|append)\(')",
    "f12_kinds": """SELECT language, CASE WHEN kind IN ('function','method','constructor','generator') THEN 'callable' WHEN kind IN ('class','struct','interface','trait','enum','impl','module','namespace') THEN 'container' ELSE 'other' END AS kind_group,
 count(*) AS n_symbols FROM (SELECT DISTINCT repo, path, id, language, kind FROM symbols) GROUP BY 1, 2""",
    "f13_private": """SELECT repo, path, id, name FROM (SELECT DISTINCT repo, path, id, language, name, signature, attributes FROM symbols WHERE name IS NOT NULL)
 WHERE CASE language WHEN 'python' THEN starts_with(name, '_') AND NOT regexp_matches(name, '^__.*__$') WHEN 'go' THEN substr(name, 1, 1) <> upper(substr(name, 1, 1))
 WHEN 'rust' THEN NOT coalesce(starts_with(signature, 'pub'), false) ELSE list_contains(attributes, 'private') END""",
    "f17_under": f"WITH {_CUR} SELECT repo, path FROM cur WHERE path = 'src/core' OR starts_with(path, 'src/core/')",
    "f18_uncommitted": f"WITH {_CUR} SELECT unit_id FROM (SELECT DISTINCT unit_id, repo, path FROM callables) c SEMI JOIN (SELECT repo, path FROM cur WHERE source_mode = 'working-tree') f USING (repo, path)",
    "g16_tests": f"WITH {_CUR} SELECT language, {_TEST} AS test, count(*) AS n_files FROM cur GROUP BY 1, 2",
    "g3_inputs": """SELECT unit_id, sha256(concat_ws(chr(10), language, kind, qualified_name, signature, nullif(trim(description, ' '), ''), source)) AS input_hash
 FROM (SELECT DISTINCT unit_id, language, kind, qualified_name, signature, description, source FROM callables)""",
    "j7_declarations": """SELECT unit_id, symbol_id FROM (SELECT DISTINCT c.unit_id, s.id AS symbol_id, abs(s.start_line - c.start_line) AS l, abs(s.start_column - c.start_column) AS k
 FROM callables c JOIN symbols s ON c.repo = s.repo AND c.path = s.path AND c.name = s.name AND s.start_line <= c.end_line AND s.end_line >= c.start_line) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY l, k, symbol_id) = 1""",
    "j9_headings": """SELECT unit_id, symbol_id, title FROM (SELECT DISTINCT m.unit_id, h.id AS symbol_id, h.start_line, h.name AS title FROM markdown_chunks m JOIN symbols h ON m.repo = h.repo AND m.path = h.path AND h.start_line <= m.start_line
 WHERE h.heading_level IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY start_line DESC, symbol_id DESC) = 1""",
    "j11_vocabulary": f"SELECT words, count(*) AS n_symbols, count(DISTINCT repo) AS n_repos FROM (SELECT DISTINCT repo, path, id, {_WORDS} AS words FROM symbols WHERE name IS NOT NULL) GROUP BY 1",
    "j13_calls": f"WITH {_CALLS} SELECT src, dst FROM e",
    "r2_callees": f"""WITH RECURSIVE {_CALLS}, r AS (SELECT DISTINCT unit_id AS id, 0 AS depth FROM callables WHERE kind = 'method' OR name = '__init__' UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 3)
 SELECT id, min(depth) AS depth FROM r GROUP BY 1""",
    "r1_call_groups": f"""WITH RECURSIVE {_CALLS}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS id, a AS at FROM b UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r."at")
 SELECT id AS unit_id, min("at") AS component FROM r GROUP BY 1""".replace("a AS at", 'a AS "at"'),
    "r3_ancestors": """WITH RECURSIVE s AS (SELECT DISTINCT repo, path, id, parent_id, name FROM symbols), r AS (SELECT repo, path, id FROM s WHERE regexp_matches(name, '^(load|fetch)')
 UNION SELECT p.repo, p.path, p.id FROM r JOIN s c ON c.repo = r.repo AND c.path = r.path AND c.id = r.id JOIN s p ON p.repo = c.repo AND p.path = c.path AND p.id = c.parent_id) SELECT DISTINCT repo, path, id FROM r""",
    "a1_line_totals": f"""WITH {_CUR}, l AS (SELECT language, {_TEST} AS t, unnest(string_split({_BODY}, chr(10))) AS line FROM cur JOIN sources s ON cur.hash = s.hash WHERE length(source) > 0),
 m AS (SELECT language, t, regexp_matches(line, '^\\s*$') AS b, regexp_matches(line, '^\\s*(//|#|/\\*|\\*|<!--)') AND NOT regexp_matches(line, '^\\s*#(include|define|if|endif|else|pragma|undef|line|!)') AS c FROM l)
 SELECT language, count(*) AS lines, count_if(b) AS blank, count_if(c AND NOT b) AS comment, count_if(NOT b AND NOT c) AS code, count_if(t) AS test_lines, count_if(t AND b) AS test_blank, count_if(t AND c AND NOT b) AS test_comment, count_if(t AND NOT b AND NOT c) AS test_code FROM m GROUP BY 1""",
    "a4_folders": f"""WITH {_CUR}, n AS (SELECT repo, path, len(string_split({_BODY}, chr(10))) AS lines FROM cur JOIN sources s ON cur.hash = s.hash),
 f AS (SELECT repo, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder, lines FROM n) SELECT repo, folder, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS n_files FROM f GROUP BY 1, 2""",
    "a6_covered": f"""SELECT repo, path, count(DISTINCT n) AS lines FROM (SELECT repo, path, unnest(range(start_line, {_ENDS} + 1)) AS n FROM callables) GROUP BY 1, 2""",
    "w1_occurrences": """WITH s AS (SELECT DISTINCT repo, path, id, qualified_name, kind, start_byte FROM symbols WHERE qualified_name IS NOT NULL),
 o AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, path, qualified_name ORDER BY start_byte, id) - 1 AS INTEGER) AS occurrence FROM s) SELECT repo, path, id, occurrence, sha256(concat_ws('|', repo, path, qualified_name, kind, occurrence)) AS identity FROM o""",
    "w2_sections": """WITH h AS (SELECT DISTINCT repo, path, id, start_line, heading_level FROM symbols WHERE heading_level IS NOT NULL), l AS (SELECT repo, path, max(end_line) AS last FROM symbols GROUP BY 1, 2)
 SELECT h.repo, h.path, h.id, coalesce((SELECT min(x.start_line) FROM h x WHERE x.repo = h.repo AND x.path = h.path AND x.start_line > h.start_line) - 1, last) AS body_end,
 coalesce((SELECT min(x.start_line) FROM h x WHERE x.repo = h.repo AND x.path = h.path AND x.start_line > h.start_line AND x.heading_level <= h.heading_level) - 1, last) AS section_end FROM h JOIN l USING (repo, path)""",
    "w9_first_matches": "SELECT repo, path, id, name FROM (SELECT DISTINCT repo, path, id, start_byte, name FROM symbols WHERE regexp_matches(name, '^merge') ORDER BY repo, path, start_byte, id LIMIT 40)",
    "x6_distances": f"""WITH {_CUR}, p AS (SELECT repo, path, lag(path) OVER (PARTITION BY repo ORDER BY path) AS before FROM cur), q AS (SELECT repo, path, before, string_split(path, '/')[:-2] AS a, string_split(before, '/')[:-2] AS b FROM p WHERE before IS NOT NULL),
 c AS (SELECT *, len(list_filter(range(1, 1 + least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS n FROM q) SELECT repo, path, CAST(CASE WHEN path = before THEN 0 ELSE 1 + len(a) + len(b) - 2 * n END AS INTEGER) AS distance FROM c""",
    "x8_slugs": r"SELECT DISTINCT name AS title, CASE WHEN s = '' THEN substr(sha256(name), 1, 12) ELSE s END AS slug FROM (SELECT name, regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM symbols WHERE heading_level IS NOT NULL AND name IS NOT NULL)",
    "x11_concise": r"SELECT unit_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 59) || '…' ELSE s END AS summary FROM (SELECT DISTINCT unit_id, trim(regexp_replace(description, '\s+', ' ', 'g')) AS s, description FROM callables WHERE description IS NOT NULL)",
    "x14_labels": f"SELECT DISTINCT unit_id, concat_ws(':', path, CASE WHEN start_line = {_ENDS} THEN CAST(start_line AS VARCHAR) ELSE start_line || '-' || {_ENDS} END, name) AS label FROM callables",
    "a12_status": f"WITH {_CUR} SELECT language, count(*) AS n_files, count(description) AS described, count_if(source_mode = 'working-tree') AS uncommitted, count_if(structure_hash IS NULL) AS unparsed FROM cur GROUP BY 1",
    "a13_errors": f"WITH {_CUR} SELECT code, count(*) AS n, count(DISTINCT repo) AS n_repos FROM (SELECT DISTINCT repo, path, ordinal, code, message FROM diagnostics) SEMI JOIN cur USING (repo, path) GROUP BY 1",
    "u4_reindexed": f"""WITH {_CUR}, o AS (SELECT repo, path, arg_min(hash, (indexed_at, hash)) AS hash FROM files GROUP BY 1, 2 HAVING count(DISTINCT indexed_at) > 1) SELECT repo, path, 'edited' AS change FROM o JOIN cur USING (repo, path) WHERE o.hash IS DISTINCT FROM cur.hash""",
    "k2_reconciled": """WITH c AS (SELECT DISTINCT unit_id, concat_ws('|', repo, path, qualified_name, start_line, kind) AS identity FROM callables), o AS (SELECT identity, min(unit_id) AS unit_id FROM c WHERE unit_id % 2 = 0 GROUP BY 1),
 n AS (SELECT DISTINCT identity FROM c ANTI JOIN o USING (identity)) SELECT identity, unit_id FROM o UNION ALL SELECT identity, (SELECT max(unit_id) FROM o) + row_number() OVER (ORDER BY substr(sha256(identity), 1, 2), identity) AS unit_id FROM n""",
}
