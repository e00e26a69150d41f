"""Queries behind maps, line counts, the knowledge base, the store and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import text as X
from strataloom.operators import calls, graph, intervals, lines, outline, sections, snapshots
from strataloom.plans.repository import _current, _lines
from strataloom.sources import load

GROUP = ["repo", "path"]


def _symbols(spark, d, *columns: str) -> DataFrame:
    return load(spark, d, "symbols").select("repo", "path", "id", *columns).distinct()


def _callables(spark, d, *columns: str) -> DataFrame:
    return load(spark, d, "callables").select("unit_id", *columns).distinct()


def _counted(spark, d) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("source", r"\r\n?", "\n"), r"\n\z", "")
    return _lines(spark, d).select("repo", "path", F.size(F.split(body, "\n", -1)).alias("lines"))


def r7_private(spark, d):
    """Symbols that are private by themselves or below a private one other than an implementation."""
    first = F.substring("name", 1, 1)
    own = (
        F.when(F.col("language") == "python", F.col("name").startswith("_") & ~F.col("name").rlike("^__.*__$"))
        .when(F.col("language") == "go", first != F.upper(first))
        .when(F.col("language") == "rust", ~F.coalesce(F.col("signature").startswith("pub"), F.lit(False)))
        .otherwise(F.array_contains("attributes", "private"))
    )
    s = load(spark, d, "symbols").withColumn("private", F.coalesce(own, F.lit(False)))
    return outline.inherited(s, GROUP, "private", F.col("kind") != "impl").where("private").select("repo", "path", "id")


def w7_hunks(spark, d):
    """Matching symbols in hunks of neighbours."""
    s = _symbols(spark, d, "parent_id", "start_line", "end_line", "heading_level", "name")
    s = s.withColumn("chosen", F.coalesce(F.col("name").rlike("[aeiou]r|[aeiou]n"), F.lit(False)))
    return outline.hunks(s, GROUP, "chosen").select("repo", "path", "id", "start_line", "hunk")


def w5_paths(spark, d):
    """Titles of the open headings above every heading."""
    h = _symbols(spark, d, "name", "start_line", "heading_level").where("heading_level IS NOT NULL")
    h = h.withColumn("name", F.coalesce("name", F.lit("?")))
    return outline.heading_paths(h, GROUP).select("repo", "path", "id", F.array_join("heading_path", " / ").alias("heading_path"))


def w10_bodies(spark, d):
    """Lines of every heading's own body, blank edges cut off: the text from below it to the next heading."""
    h = _symbols(spark, d, "start_line", "heading_level").where("heading_level IS NOT NULL")
    last = load(spark, d, "symbols").groupBy("repo", "path").agg(F.max("end_line").alias("last"))
    h = sections.section_ends(h.join(last, GROUP), GROUP, "start_line", "heading_level", "last")
    t = _lines(spark, d).select("repo", "path", F.split(F.regexp_replace("source", r"\r\n?", "\n"), "\n", -1).alias("rows"))
    body = F.array_join(F.slice("rows", F.col("start_line") + 1, F.greatest(F.col("body_end") - F.col("start_line"), F.lit(0))), "\n")
    return h.join(t, GROUP).select("repo", "path", "id", F.sha2(F.regexp_replace(body, r"\A\s+|\s+\z", ""), 256).alias("body"))


def j8_owners(spark, d):
    """For every constant and field the innermost container or callable whose bytes hold it."""
    s = _symbols(spark, d, "kind", "start_byte", "end_byte")
    return outline.innermost(
        s.where("kind IN ('constant', 'field')").select("repo", "path", "id", "start_byte"), s.where("kind IN ('class', 'impl', 'function', 'method', 'constructor')"), GROUP, "start_byte", "start_byte", "end_byte", "id"
    )


def j10_containers(spark, d):
    """For every callable the smallest declaration of its qualified name that encloses it."""
    c, s = _callables(spark, d, "repo", "path", "qualified_name", "start_line", "end_line").alias("c"), _symbols(spark, d, "qualified_name", "start_line", "end_line").alias("s")
    on = (F.col("c.repo") == F.col("s.repo")) & (F.col("c.path") == F.col("s.path")) & (F.col("c.qualified_name") == F.col("s.qualified_name"))
    both = c.join(s, on & (F.col("s.start_line") <= F.col("c.start_line")) & (F.col("s.end_line") >= F.col("c.end_line")))
    best = F.min(F.struct((F.col("s.end_line") - F.col("s.start_line")).alias("n"), F.col("s.id").alias("id")))
    return both.groupBy("c.unit_id").agg(best.alias("b")).select("unit_id", F.col("b.id").alias("symbol_id"))


def _edges(spark, d) -> DataFrame:
    return calls.call_edges(load(spark, d, "callables"))


def r4_forced(spark, d):
    """Callables whose code is shown although nothing asked for it: one call beyond those visited within less than two."""
    seeds = load(spark, d, "callables").where("name = '__init__'").select(F.col("unit_id").alias("id"))
    e = _edges(spark, d)
    seen = graph.reach(e, seeds, 1)
    return e.join(seen.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("unit_id")).distinct()


def r5_references(spark, d):
    """References of callables to other files."""
    at = _callables(spark, d, "repo", "path")
    e = _edges(spark, d).join(at.select(F.col("unit_id").alias("src"), F.col("path").alias("from_path")), "src").join(at.select(F.col("unit_id").alias("dst"), F.col("path").alias("to_path")), "dst")
    return e.where("from_path <> to_path").select("src", "dst", "from_path", "to_path")


def a21_references(spark, d):
    """Places that call a callable, grouped by file, lines in numeric order."""
    at = _callables(spark, d, "path", "start_line")
    e = _edges(spark, d).join(at.withColumnRenamed("unit_id", "src"), "src")
    spots = F.array_join(F.transform(F.array_sort(F.collect_list("start_line")), lambda x: x.cast("string")), ",")
    return e.groupBy("dst", "path").agg(spots.alias("lines"))


def j21_related(spark, d):
    """What every callable calls within three steps, by first visit."""
    seeds = load(spark, d, "callables").select(F.col("unit_id").alias("id"))
    return outline.reach_each(_edges(spark, d), seeds, 3)


def a2_range_lines(spark, d):
    """Lines with code that the callables of a file touch: each line once, blank and comment lines left out."""
    end = X.inclusive_end(F.col("start_line"), F.col("end_line"), F.col("end_column"))
    c = load(spark, d, "callables").select("repo", "path", "start_line", end.alias("last_line"))
    m = intervals.merge_ranges(c, GROUP, "start_line", "last_line")
    covered = m.select("repo", "path", F.explode(F.sequence("start_line", "last_line")).alias("n"))
    rows = lines.line_rows(_lines(spark, d), GROUP, "source").where(~F.col("blank") & ~F.col("comment"))
    return rows.join(covered, [*GROUP, "n"]).groupBy(*GROUP).agg(F.count("*").alias("lines"))


def w4_groups(spark, d):
    """Groups of comment lines that follow each other, by file."""
    rows = lines.line_rows(_lines(spark, d), GROUP, "source").where("comment AND NOT blank")
    order = Window.partitionBy(*GROUP).orderBy("n")
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(order))
    g = rows.groupBy(*GROUP, "island").agg(F.count("*").alias("size"))
    return g.groupBy(*GROUP).agg(F.count("*").alias("groups"), F.max("size").alias("longest"))


def a3_unique(spark, d):
    """Lines of every path, of several rows of a file the most."""
    s = load(spark, d, "sources").select(F.col("hash").alias("of"), F.size(F.split("source", "\n", -1)).alias("lines"))
    f = load(spark, d, "files").select("repo", "path", "hash").distinct()
    return f.join(s, f.hash == s.of).groupBy(*GROUP).agg(F.max("lines").alias("lines"))


def t9_tree(spark, d):
    """The 30 largest files and folders of all trees, and the folders above them; totals stay whole."""
    return lines.tree_top(_counted(spark, d), ["repo"], "path", "lines", 30)


def t10_files(spark, d):
    """The 50 longest files, ties by path."""
    return _counted(spark, d).orderBy(F.desc("lines"), "repo", "path").limit(50)  # a report of the first 50


def t13_budget(spark, d):
    """One limit over several workspaces: the first 100 matching symbols over all repositories."""
    s = _symbols(spark, d, "start_byte", "name").where(F.col("name").rlike("^(load|merge|scan)"))
    top = s.orderBy("repo", "path", "start_byte", "id").limit(100)  # the budget
    return top.withColumn("n", F.row_number().over(Window.orderBy("repo", "path", "start_byte", "id"))).select("n", "repo", "path", "id")


def x7_parents(spark, d):
    """The deepest folder that holds all files of a repository in a language."""
    f = _current(spark, d, "language")
    # the smallest and the largest path are enough
    return f.groupBy("repo", "language").agg(F.min("path").alias("a"), F.max("path").alias("b")).select("repo", "language", X.common_parent(F.array("a", "b")).alias("folder"))


def x9_links(spark, d):
    """Headings as they stand in a link, and back."""
    n = load(spark, d, "symbols").where("heading_level IS NOT NULL AND name IS NOT NULL").select("name").distinct()
    link = X.percent_encoded(F.col("name"))
    return n.select("name", link.alias("link"), X.percent_decoded(link).alias("back"))


def x10_truncated(spark, d):
    """Descriptions cut to 40 bytes between characters."""
    return _callables(spark, d, "description").where("description IS NOT NULL").select("unit_id", X.truncate_bytes(F.col("description"), 40).alias("text"))


def x17_closest(spark, d):
    """The known word nearest to the first word of a callable's name."""
    known = ["load", "fetch", "merge", "split", "scan", "pack", "route", "index", "parse", "bind"]
    n = load(spark, d, "callables").where("name IS NOT NULL").select(F.regexp_extract(X.symbol_words(F.col("name")), r"^(\S+)", 1).alias("word")).distinct()
    return n.select("word", X.closest(F.col("word"), known, 2).alias("closest"))


def s9_units(spark, d):
    """Every code unit with its callable, description and the key of its vector in the first profile."""
    c = _callables(spark, d, "repo", "path", "qualified_name", "description", "source_hash")
    k = load(spark, d, "unit_vectors").where("channel = 'code' AND profile_key = 'hashvec-64-a'").groupBy("unit_id").agg(F.min("embedding_key").alias("embedding_key"))
    return c.join(k, "unit_id", "left").select("unit_id", "repo", "path", "qualified_name", F.coalesce("description", F.lit("")).alias("description"), "embedding_key")


def s10_scan(spark, d):
    """Declarations of all current structures of a parser version."""
    f = _current(spark, d, "parser_version", "structure_hash").where("structure_hash IS NOT NULL AND parser_version = 'structure-v3-tuned'").select(*GROUP)
    return _symbols(spark, d, "kind").join(f, GROUP, "left_semi")


def j12_occurrences(spark, d):
    """Every place where a stored vector's text stands: keys to units of current files."""
    u = load(spark, d, "unit_vectors").select("embedding_key", "profile_key", "channel", "unit_id").distinct()
    at = _callables(spark, d, "repo", "path").unionByName(load(spark, d, "markdown_chunks").select("unit_id", "repo", "path").distinct())
    v = load(spark, d, "vectors").select("embedding_key", "profile_key").distinct()
    return v.join(u, ["embedding_key", "profile_key"]).join(at, "unit_id").select("embedding_key", "channel", "unit_id", "repo", "path")


def j16_articles(spark, d):
    """Sections whose article is stored with the text that they were cut from."""
    f = _current(spark, d, "hash", "language").where("language = 'markdown'")
    s = load(spark, d, "sources").select("hash", F.replace("source", F.lit("\r\n"), F.lit("\n")).alias("source"))
    m = load(spark, d, "markdown_chunks").select("unit_id", "repo", "path", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content")).distinct()
    a = f.join(s, "hash").select("repo", "path", "source")
    return m.join(a, GROUP).where(F.col("source").contains(F.col("content"))).select("unit_id", "repo", "path")


def s12_articles(spark, d):
    """Markdown files with their title and how many files, and ranges of them, they cite."""
    t = _lines(spark, d).where("language = 'markdown'")
    title = F.regexp_extract("source", r"(?m)^#{1,6}[ \t]+([^\n\r#]+)", 1)
    cited = F.array_distinct(F.regexp_extract_all("source", F.lit(r"[`(]([\w.-]+(?:/[\w.-]+)+\.\w+(?:(?::|#L)\d+(?:-L?\d+)?)?)[`)]"), F.lit(1)))
    return t.select("repo", "path", F.trim(title).alias("title"), F.size(cited).alias("n_cited"), F.size(F.filter(cited, lambda x: x.rlike(r"(:|#L)\d+"))).alias("n_ranges"))


def a16_articles(spark, d):
    """Articles by the best score of their sections for a stored query and by how many of their lines are not edited since: 0.9 and 0.1."""
    from strataloom.operators import search
    from strataloom.plans.search import _searched

    m = load(spark, d, "markdown_chunks").select("unit_id", "repo", "path").distinct()
    hits = search.channel_hits(*_searched(spark, d), "docs", 0.3)
    best = hits.join(m, "unit_id").groupBy(*GROUP).agg(F.max("score").alias("score"))
    edited = snapshots.changes(load(spark, d, "files").groupBy(*GROUP).agg(F.min(F.struct("indexed_at", "hash")).alias("r")).select(*GROUP, F.col("r.hash").alias("hash")), _current(spark, d, "hash"), GROUP, "hash")
    fresh = F.when(F.col("change").isNull(), 1.0).otherwise(0.5)
    out = best.join(edited, GROUP, "left").select("repo", "path", F.round(0.9 * F.col("score") + 0.1 * fresh, 6).alias("rank_score"))
    return out.orderBy(F.desc("rank_score"), "repo", "path").limit(25)  # a report of the first 25


def a19_sections(spark, d):
    """One digest for each section of the snapshot, over its rows in order."""
    parts = [("files", _current(spark, d, "hash", "language"), ["repo", "path", "hash", "language"]), ("symbols", _symbols(spark, d, "kind", "name", "start_byte", "end_byte"), ["repo", "path", "id", "kind", "name", "start_byte", "end_byte"]),
             ("callables", _callables(spark, d, "source_hash"), ["unit_id", "source_hash"]), ("vectors", load(spark, d, "unit_vectors").distinct(), ["unit_id", "channel", "profile_key", "embedding_key"])]
    out = None
    for name, df, columns in parts:
        one = snapshots.table_digest(df, columns).select(F.lit(name).alias("section"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def a22_pruned(spark, d):
    """What a garbage collection would delete: vectors that no unit of any index refers to, by profile and role."""
    v = load(spark, d, "vectors").groupBy("embedding_key", "profile_key").agg(F.min("role").alias("role"), F.max(F.coalesce(F.size("vector"), F.lit(0))).alias("n"))
    live = load(spark, d, "unit_vectors").select("embedding_key", "profile_key").distinct().withColumn("live", F.lit(True))
    at = v.join(live, ["embedding_key", "profile_key"], "left")
    dead = F.col("live").isNull()
    return at.groupBy("profile_key", "role").agg(F.count("*").alias("keys"), F.count_if(dead).alias("dead_keys"), F.sum(F.when(dead, 4 * F.greatest(F.col("n"), F.lit(0))).otherwise(0)).alias("dead_bytes"))


def k4_put(spark, d):
    """Vectors that would be added to a store that holds the queries' already: usable ones, each key once."""
    v = load(spark, d, "vectors")
    ok = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    held = v.where("role = 'query'").select("embedding_key", "profile_key").distinct()
    return v.where(ok).select("embedding_key", "profile_key").distinct().join(held, ["embedding_key", "profile_key"], "left_anti")


def u5_candidates(spark, d):
    """Files that a refresh looks at: changed in the working tree, edited since their first index, without structure, or failed to be read."""
    f = _current(spark, d, "source_mode", "structure_hash")
    edited = snapshots.changes(load(spark, d, "files").groupBy(*GROUP).agg(F.min(F.struct("indexed_at", "hash")).alias("r")).select(*GROUP, F.col("r.hash").alias("hash")), _current(spark, d, "hash"), GROUP, "hash").select(*GROUP)
    failed = load(spark, d, "diagnostics").where("code = 'read'").select(*GROUP).join(f, GROUP, "left_semi")
    return f.where("source_mode = 'working-tree'").select(*GROUP).union(edited).union(f.where("structure_hash IS NULL").select(*GROUP)).union(failed).distinct()


def a23_refresh(spark, d):
    """What a refresh of those files would report by repository."""
    c = u5_candidates(spark, d).groupBy("repo").agg(F.count("*").alias("files_updated"))
    n = _callables(spark, d, "repo", "path").join(u5_candidates(spark, d), GROUP, "left_semi").groupBy("repo").agg(F.count("*").alias("functions"))
    return c.join(n, "repo", "left").na.fill(0, ["functions"])


def u6_paths(spark, d):
    """Several roots and paths as one: overlapping files count once."""
    f = _current(spark, d, "language")
    parts = [f.where(X.under(F.col("path"), p)).select(*GROUP) for p in ("src", "src/core", "tests")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def r9_families(spark, d):
    """Repositories that share the text of a file, as families named by the smallest."""
    f = _current(spark, d, "hash").where("hash IS NOT NULL").select("repo", "hash").distinct()
    # every repository is linked to the smallest that has the text, so no text forms all pairs
    e = f.join(f.groupBy("hash").agg(F.min("repo").alias("first"), F.count("*").alias("n")).where("n > 1"), "hash").select(F.col("repo").alias("a"), F.col("first").alias("b")).distinct()
    c = graph.components(e)
    return f.select("repo").distinct().join(c.withColumnRenamed("id", "repo"), "repo", "left").select("repo", F.coalesce("component", "repo").alias("family"))


def v1_scored(spark, d):
    """Findings against the truth: callables named by the extraction of their documentation's file, by repository: precision, recall and F1."""
    gold = _symbols(spark, d, "name", "start_line", "kind").where("kind IN ('function', 'method', 'constructor') AND name IS NOT NULL").select("repo", "path", "name", "start_line").distinct()
    found = load(spark, d, "callables").where("name IS NOT NULL").select("repo", "path", "name", F.col("start_line").alias("cited")).distinct()
    at = gold.join(found, ["repo", "path", "name"], "full").withColumn("hit", F.abs(F.col("cited") - F.col("start_line")) <= 2)
    n = at.groupBy("repo").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"), F.count("cited").alias("cited"), F.count("start_line").alias("gold"))
    p, r = F.col("hits") / F.nullif("cited", F.lit(0)), F.col("hits") / F.nullif("gold", F.lit(0))
    return n.select("repo", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


def v2_groups(spark, d):
    """Count, mean, total and how many values there are, by priority and status of orders."""
    o = load(spark, d, "orders")
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.count(v).alias("n_values"), F.round(F.avg(v), 4).alias("mean"), F.round(F.sum(v), 2).alias("total"))


def v3_paired(spark, d):
    """Two arms paired by user: events of one type against another; mean of ratios and ratio of sums, over all and over pairs with both."""
    e = load(spark, d, "events")
    arm = lambda t, n: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.sum("value").alias(n))
    at = arm("view", "a").join(arm("click", "b"), "user_id", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return at.agg(
        F.count("*").alias("n_pairs"), F.count_if(both).alias("n_both"), F.round(F.avg(F.when(both, F.col("b") - F.col("a"))), 6).alias("mean_delta"),
        F.round(F.avg(F.when(both, F.col("b") / F.col("a"))), 6).alias("mean_ratio"), F.round(F.sum(F.when(both, F.col("b"))) / F.sum(F.when(both, F.col("a"))), 6).alias("ratio_of_sums"),
    )


def v4_arms(spark, d):
    """Medians of values by type of event, and how often a user has it and purchases or not."""
    e = load(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("user_id").distinct().withColumn("buys", F.lit(True))
    at = e.join(buys, "user_id", "left")
    n = at.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.count_distinct(F.when(F.col("buys"), F.col("user_id"))).alias("buyers"), F.count_distinct(F.when(F.col("buys").isNull(), F.col("user_id"))).alias("others"))
    return n


def w8_days(spark, d):
    """Daily counts of the last 90 days, and totals of the whole lifetime beside them."""
    from strataloom.streaming import usage

    n = usage.daily_counts(load(spark, d, "events"))
    total = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("lifetime"))
    last = Window.partitionBy()  # one row a day and type
    kept = n.withColumn("newest", F.max("day").over(last)).where(F.datediff("newest", "day") < 90)
    return kept.join(total, "event_type").select("day", "event_type", "n", "lifetime")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0].islower() and k.split("_")[0][1:].isdigit()}

_CUR = "cur AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC) = 1)"
_BODY = r"regexp_replace(replace(replace(source, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\z', '')"
_CALLS = r"""c AS (SELECT DISTINCT unit_id, repo, name, source FROM callables), one AS (SELECT repo, name, min(unit_id) AS dst FROM c WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT unit_id) = 1),
 e AS (SELECT DISTINCT unit_id AS src, dst FROM (SELECT unit_id, repo, unnest(list_distinct(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS name FROM c) s JOIN one USING (repo, name))"""
_P = "coalesce(CASE language WHEN 'python' THEN starts_with(name, '_') AND NOT regexp_matches(name, '^__.*__$') WHEN 'go' THEN substr(name, 1, 1) <> upper(substr(name, 1, 1)) WHEN 'rust' THEN NOT coalesce(starts_with(signature, 'pub'), false) ELSE list_contains(attributes, 'private') END, false)"
_ENDS = "greatest(coalesce(CASE WHEN end_column = 1 THEN end_line - 1 ELSE end_line END, start_line), start_line)"
_COUNT = f"n AS (SELECT repo, path, CAST(len(string_split({_BODY}, chr(10))) AS INTEGER) AS lines FROM cur JOIN sources s ON cur.hash = s.hash)"
_OLD = "old AS (SELECT repo, path, arg_min(hash, (indexed_at, hash)) AS was FROM files GROUP BY 1, 2)"
_CAND = f"""{_CUR}, {_OLD}, cand AS (SELECT repo, path FROM cur WHERE source_mode = 'working-tree' OR structure_hash IS NULL UNION SELECT repo, path FROM cur JOIN old USING (repo, path) WHERE was IS DISTINCT FROM hash
 UNION SELECT repo, path FROM diagnostics SEMI JOIN cur USING (repo, path) WHERE code = 'read')"""

ORACLES = {
    "r7_private": f"""WITH RECURSIVE s AS (SELECT repo, path, id, min(parent_id) AS parent_id, max({_P}) AS p, max({_P} AND kind <> 'impl') AS o FROM symbols GROUP BY 1, 2, 3),
 r AS (SELECT repo, path, id, o AS up FROM s WHERE p UNION SELECT c.repo, c.path, c.id, r.up OR c.o FROM r JOIN s c ON c.repo = r.repo AND c.path = r.path AND c.parent_id = r.id WHERE r.up) SELECT DISTINCT repo, path, id FROM r""",
    "w7_hunks": """WITH s AS (SELECT DISTINCT repo, path, id, parent_id, start_line, end_line, heading_level, coalesce(regexp_matches(name, '[aeiou]r|[aeiou]n'), false) AS c FROM symbols),
 a AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER w AS out FROM s WINDOW w AS (PARTITION BY repo, path, parent_id ORDER BY start_line, id ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, CASE WHEN start_line - lag(end_line) OVER w - 1 <= 4 AND lag(out) OVER w = out AND (lag(heading_level) OVER w IS NOT NULL) = (heading_level IS NOT NULL) THEN 0 ELSE 1 END AS fresh FROM a WHERE c WINDOW w AS (PARTITION BY repo, path, parent_id ORDER BY start_line, id))
 SELECT repo, path, id, start_line, CAST(sum(fresh) OVER (PARTITION BY repo, path, parent_id ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS hunk FROM b""",
    "w5_paths": """WITH h AS (SELECT DISTINCT repo, path, id, coalesce(name, '?') AS name, start_line, heading_level AS l FROM symbols WHERE heading_level IS NOT NULL),
 o AS (SELECT h.repo, h.path, h.id, g.name, g.start_line FROM h JOIN h g ON g.repo = h.repo AND g.path = h.path AND g.start_line < h.start_line AND g.l < h.l
   WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.repo = h.repo AND k.path = h.path AND k.start_line > g.start_line AND k.start_line < h.start_line AND k.l <= g.l))
 SELECT h.repo, h.path, h.id, coalesce((SELECT string_agg(o.name, ' / ' ORDER BY o.start_line) FROM o WHERE o.repo = h.repo AND o.path = h.path AND o.id = h.id) || ' / ', '') || h.name AS heading_path FROM h""",
    "w10_bodies": rf"""WITH {_CUR}, h AS (SELECT DISTINCT repo, path, id, start_line FROM symbols WHERE heading_level IS NOT NULL), l AS (SELECT repo, path, max(end_line) AS last FROM symbols GROUP BY 1, 2),
 b AS (SELECT h.*, coalesce(lead(start_line) OVER (PARTITION BY h.repo, h.path ORDER BY start_line) - 1, last) AS body_end FROM h JOIN l USING (repo, path)),
 t AS (SELECT repo, path, string_split(replace(replace(source, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS rows FROM cur JOIN sources s ON cur.hash = s.hash)
 SELECT repo, path, id, sha256(regexp_replace(array_to_string(rows[start_line + 1:body_end], chr(10)), '\A\s+|\s+\z', '', 'g')) AS body FROM b JOIN t USING (repo, path)""",
    "j8_owners": """WITH s AS (SELECT DISTINCT repo, path, id, kind, start_byte, end_byte FROM symbols), p AS (SELECT * FROM s WHERE kind IN ('constant', 'field')), r AS (SELECT * FROM s WHERE kind IN ('class', 'impl', 'function', 'method', 'constructor'))
 SELECT p.repo, p.path, p.id, p.start_byte, arg_min(r.id, (r.end_byte - r.start_byte, r.id)) AS owner FROM p LEFT JOIN r ON r.repo = p.repo AND r.path = p.path AND r.start_byte <= p.start_byte AND p.start_byte < r.end_byte GROUP BY ALL""",
    "j10_containers": """SELECT unit_id, arg_min(s.id, (s.end_line - s.start_line, s.id)) AS symbol_id FROM callables c JOIN symbols s ON c.repo = s.repo AND c.path = s.path AND c.qualified_name = s.qualified_name AND s.start_line <= c.start_line AND s.end_line >= c.end_line GROUP BY 1""",
    "r4_forced": f"WITH {_CALLS}, s AS (SELECT DISTINCT unit_id AS id FROM callables WHERE name = '__init__'), v AS (SELECT id FROM s UNION SELECT dst FROM e JOIN s ON e.src = s.id) SELECT DISTINCT dst AS unit_id FROM e JOIN v ON e.src = v.id",
    "r5_references": f"WITH {_CALLS}, p AS (SELECT DISTINCT unit_id, path FROM callables) SELECT src, dst, a.path AS from_path, b.path AS to_path FROM e JOIN p a ON a.unit_id = src JOIN p b ON b.unit_id = dst WHERE a.path <> b.path",
    "a21_references": f"WITH {_CALLS}, p AS (SELECT DISTINCT unit_id, path, start_line FROM callables) SELECT dst, path, string_agg(CAST(start_line AS VARCHAR), ',' ORDER BY start_line) AS lines FROM e JOIN p ON p.unit_id = src GROUP BY 1, 2",
    "j21_related": f"""WITH RECURSIVE {_CALLS}, r AS (SELECT DISTINCT unit_id AS seed, unit_id AS id, 0 AS depth FROM callables UNION SELECT seed, e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 3)
 SELECT seed, id, min(depth) AS depth FROM r WHERE seed <> id GROUP BY 1, 2""",
    "a2_range_lines": rf"""WITH {_CUR}, l AS (SELECT repo, path, unnest(string_split({_BODY}, chr(10))) AS line, unnest(range(1, len(string_split({_BODY}, chr(10))) + 1)) AS n FROM cur JOIN sources s ON cur.hash = s.hash WHERE length(source) > 0),
 c AS (SELECT DISTINCT repo, path, unnest(range(start_line, {_ENDS} + 1)) AS n FROM callables)
 SELECT repo, path, count(*) AS lines FROM l JOIN c USING (repo, path, n) WHERE NOT regexp_matches(line, '^\s*$') AND NOT (regexp_matches(line, '^\s*(//|#|/\*|\*|<!--)') AND NOT regexp_matches(line, '^\s*#(include|define|if|endif|else|pragma|undef|line|!)')) GROUP BY 1, 2""",
    "w4_groups": rf"""WITH {_CUR}, l AS (SELECT repo, path, unnest(string_split({_BODY}, chr(10))) AS line, unnest(range(1, len(string_split({_BODY}, chr(10))) + 1)) AS n FROM cur JOIN sources s ON cur.hash = s.hash WHERE length(source) > 0),
 c AS (SELECT repo, path, n - row_number() OVER (PARTITION BY repo, path ORDER BY n) AS island FROM l WHERE regexp_matches(line, '^\s*(//|#|/\*|\*|<!--)') AND NOT regexp_matches(line, '^\s*#(include|define|if|endif|else|pragma|undef|line|!)')), g AS (SELECT repo, path, island, count(*) AS size FROM c GROUP BY 1, 2, 3)
 SELECT repo, path, count(*) AS groups, max(size) AS longest FROM g GROUP BY 1, 2""",
    "a3_unique": "SELECT repo, path, CAST(max(len(string_split(source, chr(10)))) AS INTEGER) AS lines FROM files f JOIN sources s ON f.hash = s.hash GROUP BY 1, 2",
    "t9_tree": f"""WITH {_CUR}, {_COUNT}, f AS (SELECT repo, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS entry, lines FROM n),
 g AS (SELECT repo, entry, CAST(sum(lines) AS BIGINT) AS lines, true AS folder FROM f WHERE entry <> '' GROUP BY 1, 2 UNION ALL SELECT repo, path, lines, false FROM n), t AS (SELECT * FROM g ORDER BY lines DESC, repo, entry LIMIT 30)
 SELECT repo, entry, folder, lines, true AS chosen FROM t UNION ALL SELECT repo, entry, folder, lines, false FROM g WHERE folder AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo = g.repo AND t.entry = g.entry AND t.folder) AND EXISTS (SELECT 1 FROM t WHERE t.repo = g.repo AND starts_with(t.entry, g.entry || '/'))""",
    "t10_files": f"WITH {_CUR}, {_COUNT} SELECT repo, path, lines FROM n ORDER BY lines DESC, repo, path LIMIT 50",
    "t13_budget": "SELECT CAST(row_number() OVER (ORDER BY repo, path, start_byte, id) AS INTEGER) AS n, repo, path, id FROM (SELECT DISTINCT repo, path, id, start_byte, name FROM symbols WHERE regexp_matches(name, '^(load|merge|scan)')) QUALIFY n <= 100",
    "x7_parents": f"""WITH {_CUR}, m AS (SELECT repo, language, list(string_split(path, '/')[:-2]) AS ps, min(len(string_split(path, '/'))) - 1 AS k FROM cur GROUP BY 1, 2)
 SELECT repo, language, array_to_string(ps[1][1:len(list_filter(range(1, k + 1), lambda i: len(list_distinct(list_transform(ps, lambda p: p[1:i]))) = 1))], '/') AS folder FROM m""",
    "x9_links": "SELECT DISTINCT name, replace(url_encode(name), '%2F', '/') AS link, name AS back FROM symbols WHERE heading_level IS NOT NULL AND name IS NOT NULL",
    "x10_truncated": "SELECT DISTINCT unit_id, CASE WHEN strlen(description) <= 40 THEN description ELSE substr(description, 1, len(list_filter(range(1, 42), lambda i: strlen(substr(description, 1, i)) <= 40 AND i <= length(description)))) END AS text FROM callables WHERE description IS NOT NULL",
    "x17_closest": r"""WITH w AS (SELECT DISTINCT regexp_extract(W, '^(\S+)', 1) AS word FROM (SELECT name FROM callables WHERE name IS NOT NULL)), k AS (SELECT unnest(['load','fetch','merge','split','scan','pack','route','index','parse','bind']) AS known)
 SELECT word, arg_min(known, (levenshtein(word, known), known)) FILTER (levenshtein(word, known) <= 2) AS closest FROM w, k GROUP BY 1""",
    "s9_units": """SELECT unit_id, repo, path, qualified_name, coalesce(description, '') AS description, embedding_key FROM (SELECT DISTINCT unit_id, repo, path, qualified_name, description, source_hash FROM callables)
 LEFT JOIN (SELECT unit_id, min(embedding_key) AS embedding_key FROM unit_vectors WHERE channel = 'code' AND profile_key = 'hashvec-64-a' GROUP BY 1) USING (unit_id)""",
    "s10_scan": f"WITH {_CUR} SELECT DISTINCT repo, path, id, kind FROM symbols SEMI JOIN (SELECT * FROM cur WHERE structure_hash IS NOT NULL AND parser_version = 'structure-v3-tuned') USING (repo, path)",
    "j12_occurrences": """SELECT embedding_key, channel, unit_id, repo, path FROM (SELECT DISTINCT embedding_key, profile_key FROM vectors) JOIN (SELECT DISTINCT * FROM unit_vectors) USING (embedding_key, profile_key)
 JOIN (SELECT DISTINCT unit_id, repo, path FROM callables UNION ALL SELECT DISTINCT unit_id, repo, path FROM markdown_chunks) USING (unit_id)""",
    "j16_articles": f"""WITH {_CUR} SELECT DISTINCT m.unit_id, m.repo, m.path FROM markdown_chunks m JOIN cur USING (repo, path) JOIN sources s ON s.hash = cur.hash WHERE cur.language = 'markdown' AND contains(replace(source, chr(13) || chr(10), chr(10)), replace(content, chr(13) || chr(10), chr(10)))""",
    "s12_articles": rf"""WITH {_CUR}, c AS (SELECT repo, path, regexp_extract(source, '(?m)^#{{1,6}}[ \t]+([^\n\r#]+)', 1) AS t, list_distinct(regexp_extract_all(source, '[`(]([\w.-]+(?:/[\w.-]+)+\.\w+(?:(?::|#L)\d+(?:-L?\d+)?)?)[`)]', 1)) AS x FROM cur JOIN sources s ON cur.hash = s.hash WHERE language = 'markdown')
 SELECT repo, path, trim(t) AS title, CAST(len(x) AS INTEGER) AS n_cited, CAST(len(list_filter(x, lambda y: regexp_matches(y, '(:|#L)\d+'))) AS INTEGER) AS n_ranges FROM c""",
    "a19_sections": f"""WITH {_CUR}, r AS (SELECT 'files' AS section, sha256(concat_ws(chr(31), repo, path, coalesce(hash, chr(0)), coalesce(language, chr(0)))) AS h FROM cur
 UNION ALL SELECT 'symbols', sha256(concat_ws(chr(31), repo, path, CAST(id AS VARCHAR), coalesce(kind, chr(0)), coalesce(name, chr(0)), coalesce(CAST(start_byte AS VARCHAR), chr(0)), coalesce(CAST(end_byte AS VARCHAR), chr(0)))) FROM (SELECT DISTINCT repo, path, id, kind, name, start_byte, end_byte FROM symbols)
 UNION ALL SELECT 'callables', sha256(concat_ws(chr(31), CAST(unit_id AS VARCHAR), coalesce(source_hash, chr(0)))) FROM (SELECT DISTINCT unit_id, source_hash FROM callables)
 UNION ALL SELECT 'vectors', sha256(concat_ws(chr(31), CAST(unit_id AS VARCHAR), channel, profile_key, embedding_key)) FROM (SELECT DISTINCT unit_id, channel, profile_key, embedding_key FROM unit_vectors)),
 b AS (SELECT section, substr(h, 1, 4) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1, 2) SELECT section, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(b || d, '' ORDER BY b)) AS digest FROM b GROUP BY 1""",
    "a22_pruned": """WITH v AS (SELECT embedding_key, profile_key, min(role) AS role, max(coalesce(len(vector), 0)) AS n FROM vectors GROUP BY 1, 2), l AS (SELECT DISTINCT embedding_key, profile_key, true AS live FROM unit_vectors)
 SELECT profile_key, role, count(*) AS keys, count_if(live IS NULL) AS dead_keys, CAST(sum(CASE WHEN live IS NULL THEN 4 * n ELSE 0 END) AS BIGINT) AS dead_bytes FROM v LEFT JOIN l USING (embedding_key, profile_key) GROUP BY 1, 2""",
    "k4_put": """SELECT DISTINCT embedding_key, profile_key FROM vectors v WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
 AND NOT EXISTS (SELECT 1 FROM vectors q WHERE q.role = 'query' AND q.embedding_key = v.embedding_key AND q.profile_key = v.profile_key)""",
    "u5_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "a23_refresh": f"WITH {_CAND}, n AS (SELECT repo, count(*) AS functions FROM (SELECT DISTINCT unit_id, repo, path FROM callables) SEMI JOIN cand USING (repo, path) GROUP BY 1) SELECT repo, count(*) AS files_updated, coalesce(any_value(functions), 0) AS functions FROM cand LEFT JOIN n USING (repo) GROUP BY 1",
    "u6_paths": f"WITH {_CUR} SELECT repo, path FROM cur WHERE starts_with(path, 'src/') OR starts_with(path, 'tests/') OR path IN ('src', 'tests')",
    "r9_families": f"""WITH RECURSIVE {_CUR}, f AS (SELECT DISTINCT repo, hash FROM cur WHERE hash IS NOT NULL), e AS (SELECT DISTINCT a.repo AS a, b.repo AS b FROM f a JOIN f b USING (hash)), r AS (SELECT repo AS a, repo AS b FROM f UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS repo, min(b) AS family FROM r GROUP BY 1""",
    "v1_scored": """WITH g AS (SELECT DISTINCT repo, path, name, start_line FROM symbols WHERE kind IN ('function', 'method', 'constructor') AND name IS NOT NULL), f AS (SELECT DISTINCT repo, path, name, start_line AS cited FROM callables WHERE name IS NOT NULL),
 n AS (SELECT repo, count_if(abs(cited - start_line) <= 2) AS hits, count(cited) AS cited, count(start_line) AS gold FROM g FULL JOIN f USING (repo, path, name) GROUP BY 1), p AS (SELECT *, hits / nullif(cited, 0) AS p, hits / nullif(gold, 0) AS r FROM n)
 SELECT repo, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM p""",
    "v2_groups": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(v) AS n_values, round(avg(v), 4) AS mean, round(sum(v), 2) AS total FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY 1, 2",
    "v3_paired": """WITH a AS (SELECT user_id, sum(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, sum(value) AS b FROM events WHERE event_type = 'click' GROUP BY 1), t AS (SELECT * FROM a FULL JOIN b USING (user_id))
 SELECT count(*) AS n_pairs, count_if(a IS NOT NULL AND b IS NOT NULL) AS n_both, round(avg(b - a), 6) AS mean_delta, round(avg(b / a), 6) AS mean_ratio, round(sum(CASE WHEN a IS NOT NULL THEN b END) / sum(CASE WHEN b IS NOT NULL THEN a END), 6) AS ratio_of_sums FROM t""",
    "v4_arms": """WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT event_type, round(median(value), 6) AS median, count(DISTINCT CASE WHEN user_id IN (SELECT user_id FROM p) THEN user_id END) AS buyers,
 count(DISTINCT CASE WHEN user_id NOT IN (SELECT user_id FROM p) THEN user_id END) AS others FROM events GROUP BY 1""",
    "w8_days": "WITH n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT day, event_type, n, sum(n) OVER (PARTITION BY event_type)::BIGINT AS lifetime FROM n QUALIFY day > (SELECT max(day) FROM n) - 90",
}


def _finish() -> None:
    from strataloom.plans.search import _HITS, _words

    ORACLES["x17_closest"] = ORACLES["x17_closest"].replace("W,", _words("name") + ",", 1)
    ORACLES["a16_articles"] = f"""WITH {_HITS}, {_CUR}, {_OLD}, b AS (SELECT repo, path, max(score) AS score FROM h JOIN (SELECT DISTINCT unit_id, repo, path FROM markdown_chunks) USING (unit_id) WHERE channel = 'docs' GROUP BY 1, 2)
 SELECT repo, path, round(0.9 * score + 0.1 * CASE WHEN was IS DISTINCT FROM hash THEN 0.5 ELSE 1.0 END, 6) AS rank_score FROM b JOIN cur USING (repo, path) JOIN old USING (repo, path) ORDER BY rank_score DESC, repo, path LIMIT 25"""


_finish()
