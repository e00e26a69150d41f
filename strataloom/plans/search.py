"""Queries of the search pipeline, the index and cross-search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom import runtime
from strataloom.functions import text as X
from strataloom.functions.vectors import HashVector, cosine, embed_table, unit_length
from strataloom.operators import graph, intervals, knn, search
from strataloom.sources import current_files, load

PROFILE = "hashvec-64-a"
TEXTS = ["which module owns the cache of the ledger", "retry the upload when the queue is full", "tests for parsing nested records"]


def _asked(spark) -> DataFrame:
    """The query texts and their vectors."""
    v = HashVector().embed(TEXTS, query=True)
    return spark.createDataFrame([(str(i), [float(x) for x in r]) for i, r in enumerate(v)], "query_id string, vector array<double>")


def _vectors(spark, d) -> DataFrame:
    """(key, role, vector) of the profile's usable vectors, one row a key."""
    v = load(spark, d, "vectors").where(F.col("profile_key") == PROFILE)
    ok = (F.size("vector") == 64) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    return v.where(ok).groupBy(F.col("embedding_key").alias("key")).agg(F.min("role").alias("role"), F.min("vector").alias("vector"))


def _units(spark, d) -> DataFrame:
    u = load(spark, d, "unit_vectors").where(F.col("profile_key") == PROFILE)
    return u.select("unit_id", "channel", F.col("embedding_key").alias("key")).distinct()


def _searched(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, units, vectors) of the search with all stored queries; the vectors are settled once, as they are read more than once."""
    v = runtime.cut(_vectors(spark, d))
    return v.where("role = 'query'").select(F.col("key").alias("query_id"), "vector"), _units(spark, d), v


def _merged(spark, d) -> DataFrame:
    """Of every unit that a stored query hits its best hit."""
    return search.merged_hits(*_searched(spark, d), 0.3)


def _callables(spark, d, *columns: str) -> DataFrame:
    return load(spark, d, "callables").select("unit_id", *columns).distinct()


def j1_search(spark, d):
    """Best 20 units of every stored query over all channels, and whether more were left out."""
    return search.limited(search.top_hits(*_searched(spark, d), 20, 0.3), ["unit_id"], 20, ["query_id"]).select("query_id", "unit_id", "channel", "score", "rank", "omitted")


def a7_search(spark, d):
    """All queries as one search: each unit with its best hit, one limit over all."""
    return search.limited(_merged(spark, d), ["unit_id"], 200).select("query_id", "unit_id", "channel", "score", "rank", "omitted")


def a20_by_file(spark, d):
    """Files of the callables that were hit, in the order of their best hit."""
    return search.by_file(_merged(spark, d).join(_callables(spark, d, "repo", "path"), "unit_id"), ["repo", "path"])


def f24_expanded(spark, d):
    """Hits that are close enough to be shown with their source: strictly above 0.9."""
    c = load(spark, d, "callables").select("unit_id", "path", "start_line", "source")
    # told apart after the join, so only texts that were hit are, where they lie
    at = _merged(spark, d).where("score > 0.9").join(c, "unit_id").select("unit_id", "path", "start_line", "score", "source").distinct()
    return at.select("unit_id", "path", "start_line", "score", F.octet_length("source").alias("n_bytes"))


def j6_components(spark, d):
    """Cosine of every unit's code to its description, 0 where either is missing or unusable."""
    v = _vectors(spark, d).select("key", "vector")
    one = lambda channel: _units(spark, d).where(F.col("channel") == channel).groupBy("unit_id").agg(F.min("key").alias("key")).join(v, "key", "left").select("unit_id", F.col("vector").alias(channel))
    return one("code").join(one("descriptions"), "unit_id", "left").select("unit_id", F.round(cosine(F.col("code"), F.col("descriptions")), 6).alias("score"))


def j20_files(spark, d):
    """Files whose description is near a text, all of them from 0.3 on."""
    f = current_files(load(spark, d, "files"), ["description"]).where("description IS NOT NULL")
    # one text is embedded once, however many files have it
    e = embed_table(f.select("description").distinct(), "description", "description", HashVector()).withColumnRenamed("key", "id")
    got = knn.nearest(_asked(spark), e, None, 0.3).groupBy(F.col("id").alias("description")).agg(F.round(F.max("score"), 6).alias("score"))
    return f.join(got, "description").select("repo", "path", "score")


def _names(spark, d) -> DataFrame:
    s = load(spark, d, "symbols").where("name IS NOT NULL")
    own = F.array(X.symbol_words(F.col("name")))
    alias = F.transform(F.coalesce("names", F.array().cast("array<string>")), X.symbol_words)
    return s.select("repo", "path", "id", F.concat(own, alias).alias("spellings")).distinct()


def _name_scores(spark, d, low: float) -> DataFrame:
    words = _names(spark, d).select(F.explode("spellings").alias("words")).where("words <> ''").distinct()
    e = embed_table(words, "words", "words", HashVector()).withColumnRenamed("key", "words")
    return search.semantic_names(_asked(spark), e, low)


def j11_symbols(spark, d):
    """Symbols whose name or an alias is near a text: each distinct name is scored once."""
    hits = search.symbol_hits(_names(spark, d), _name_scores(spark, d, 0.3), 0.3)
    return hits.withColumn("score", F.round("score", 6))


def f7_semantic(spark, d):
    """Symbols selected by a pattern or by the meaning of their name."""
    sel = search.Selection(patterns=["^(load|fetch)"], paths=["!**/tests/**"], kinds=["callable"], semantic=_name_scores(spark, d, 0.5))
    s = load(spark, d, "symbols").where("name IS NOT NULL").where(sel.files(F.col("path")) & sel.kind(F.col("kind")))
    s = s.select("repo", "path", "id", "name", X.symbol_words(F.col("name")).alias("words")).distinct()
    return sel.apply(s, sel.named(F.col("name")), "words").select("repo", "path", "id", "name")


def f9_nodes(spark, d):
    """Symbols whose qualified name, or an alias in the same scope, matches."""
    sel = search.Selection(patterns=[r"(^|\.)(load|fetch)\w*$"], kinds=["callable", "constant"])
    scope = F.regexp_extract("qualified_name", r"^(.*\.)?[^.]*$", 1)
    s = load(spark, d, "symbols").where(sel.kind(F.col("kind")))
    alias = F.transform("names", lambda n: F.concat(scope, n))
    return s.where(sel.named(F.col("qualified_name"), aliases=alias)).select("repo", "path", "id", "qualified_name").distinct()


def f10_units(spark, d):
    """Callables whose declaration matches; those without one are matched by their own name."""
    from strataloom.plans.repository import j7_declarations

    c = _callables(spark, d, "repo", "path", "qualified_name", "name")
    s = load(spark, d, "symbols").groupBy("repo", "path", F.col("id").alias("symbol_id")).agg(F.max("qualified_name").alias("declared"))
    at = c.join(j7_declarations(spark, d), "unit_id", "left").join(s, ["repo", "path", "symbol_id"], "left")
    sel = search.Selection(patterns=["merge", "split"], ignore_case=True)
    return at.where(sel.named(F.coalesce("declared", "qualified_name", "name"))).select("unit_id").distinct()


def f11_files(spark, d):
    """Files by folder, globs, format group and a pattern on the path."""
    sel = search.Selection(paths=["**/*.py", "**/*.md", "!**/tests/**"], groups=["code"], patterns=["index|route"])
    f = current_files(load(spark, d, "files"), ["hash"])
    return f.where(sel.files(F.col("path")) & sel.named(F.col("path"))).select("repo", "path")


def t6_reranked(spark, d):
    """The best 20 callables of the merged search, reordered by how many words of a text their source holds."""
    asked = set(TEXTS[0].split())

    def overlap(query: str, docs: list[str]) -> list[tuple[int, float]]:
        return [(i, float(len(asked & set(x.lower().split())))) for i, x in enumerate(docs)]

    # a unit of the best has at least one source, so as many units as candidates hold all of these; their texts are read alone
    one = _merged(spark, d).join(_callables(spark, d), "unit_id", "left_semi")
    top = runtime.cut(one.orderBy(F.desc("score"), "unit_id").limit(search.rerank_budget(20, True)))
    one = F.broadcast(top).join(load(spark, d, "callables").select("unit_id", "source"), "unit_id").distinct()
    out = search.reranked(one, TEXTS[0], "source", overlap, ["unit_id"], 20)
    return out.select("unit_id", "similarity", "rerank_score", "rank")


def a10_inspect(spark, d):
    """Entries of the index whose text matches, with their best score over all stored queries, in both orders."""
    best = _merged(spark, d).select("unit_id", "score")
    text = F.concat_ws("\n", "path", "name", "source")
    c = load(spark, d, "callables").where(text.rlike(r"(?m)^(def|func|fn) \w*(load|merge)")).select("unit_id", "path").distinct()
    at = c.join(best, "unit_id", "left").select("unit_id", "path", F.coalesce("score", F.lit(-1.0)).alias("score"))
    unit, path = F.asc_nulls_last("unit_id"), F.asc_nulls_last("path")
    return search.ranks(search.ranks(at, "rank", [F.desc("score"), unit, path]), "original", [path, unit])


def f25_exclusions(spark, d):
    """Source hashes that selectors of a file and a symbol name: here every callable named load_* or merge*."""
    c = _callables(spark, d, "repo", "path", "name", "qualified_name", "source_hash")
    sel = c.where(F.col("name").rlike("^(load|merge)")).select("repo", "path", F.col("name").alias("symbol")).distinct()
    return search.excluded_hashes(sel, c)


def x5_units(spark, d):
    """Stored vectors that can be scaled to length 1, and whether they then have it."""
    v = load(spark, d, "vectors").select("embedding_key", unit_length(F.col("vector"), 64).alias("u")).where("u IS NOT NULL")
    size = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("embedding_key", (F.abs(size - 1) < 1e-5).alias("unit")).distinct()


def _cross(spark, d) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, score; callables): five most similar callables of other files for every twentieth."""
    skip = f25_exclusions(spark, d)
    c = _callables(spark, d, "repo", "path", "name", "start_line", "end_line", "end_column", "line_count", "source_hash")
    c = c.where((F.col("line_count") >= 2) & (F.col("line_count") < 200)).join(skip, "source_hash", "left_anti")
    keys = _units(spark, d).where("channel = 'code'").groupBy("unit_id").agg(F.min("key").alias("key"))
    at = c.join(keys, "unit_id").join(_vectors(spark, d).select("key", "vector"), "key")
    rows = at.select(F.col("unit_id").alias("id"), "vector", F.concat_ws("/", "repo", "path").alias("file"))
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = knn.nearest(asked, rows, 5, 0.8, apart="file")
    pairs = knn.one_direction(found, "query_id", "id", "score")
    return pairs.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score")), c


def j4_files(spark, d):
    """Similar callables across files with the distance of their files, far ones first; each pair once."""
    pairs, c = _cross(spark, d)
    side = lambda k: c.select(F.col("unit_id").alias(k), F.concat_ws("/", "repo", "path").alias(f"path_{k}"))
    at = pairs.join(side("a"), "a").join(side("b"), "b")
    return at.select("a", "b", "score", X.path_distance(F.col("path_a"), F.col("path_b")).alias("distance")).orderBy(F.desc("distance"), F.desc("score"), "a", "b")


def a5_ranked(spark, d):
    """Clusters of those pairs by rank: best score times covered lines, then score, lines and first label."""
    pairs, c = _cross(spark, d)
    node = graph.components(pairs.select("a", "b"))
    end = X.inclusive_end(F.col("start_line"), F.col("end_line"), F.col("end_column"))
    m = node.join(c.select(F.col("unit_id").alias("id"), "repo", "path", "name", "start_line", end.alias("last_line")), "id")
    lines = intervals.covered_lines(m, ["component", "repo", "path"], "start_line", "last_line").groupBy("component").agg(F.sum("lines").alias("lines"))
    label = F.min(F.concat_ws(":", "repo", "path", "start_line", "name")).alias("label")
    size = m.groupBy("component").agg(F.count("*").alias("members"), label)
    s = pairs.join(node.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    out = size.join(s, "component").join(lines, "component").withColumn("rank", F.round(F.col("high") * F.col("lines"), 6))
    return out.select("members", "low", "high", "lines", "rank", "label").orderBy(F.desc("rank"), F.desc("high"), F.desc("lines"), "label").limit(100)  # a report of the first 100


def j5_indexes(spark, d):
    """Similar callables of two indexes with one profile: of the largest repository against all others."""
    c = _callables(spark, d, "repo")
    big = c.groupBy("repo").count().orderBy(F.desc("count"), "repo").limit(1).select(F.col("repo").alias("big"))
    keys = _units(spark, d).where("channel = 'code'").groupBy("unit_id").agg(F.min("key").alias("key"))
    at = c.join(keys, "unit_id").join(F.broadcast(big), F.lit(True), "left").join(_vectors(spark, d).select("key", "vector"), "key")
    mine = at.where("repo = big AND unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), "vector")
    rest = at.where("repo <> big").select(F.col("unit_id").alias("id"), "vector")
    return knn.nearest(mine, rest, 5, 0.8).withColumn("score", F.round("score", 6))


def f19_changed(spark, d):
    """Callables whose name the base has, but not their text: the base is the largest repository."""
    c = _callables(spark, d, "repo", "qualified_name", "source_hash")
    big = c.groupBy("repo").count().orderBy(F.desc("count"), "repo").limit(1).select(F.col("repo").alias("big"))
    base = c.join(F.broadcast(big), c.repo == F.col("big")).select("qualified_name", "source_hash").distinct()
    rest = c.join(F.broadcast(big), c.repo == F.col("big"), "left_anti").join(base.select("qualified_name").distinct(), "qualified_name", "left_semi")
    return rest.join(base, ["qualified_name", "source_hash"], "left_anti").select("unit_id").distinct()


def j2_delta(spark, d):
    """Nearest documents of every stored query over a base of one half of the keys and a delta of the other."""
    v = _vectors(spark, d)
    asked = v.where("role = 'query'").select(F.col("key").alias("query_id"), "vector")
    docs = v.where("role = 'document'").select(F.col("key").alias("id"), "vector")
    late = F.substring("id", 1, 1).isin("8", "9", "a", "b", "c", "d", "e", "f")
    out = knn.with_delta(asked, docs.where(~late), docs.where(late), docs.where(F.substring("id", 1, 2) == "00").select("id"), 5)
    return out.withColumn("score", F.round("score", 6))


def u1_union(spark, d):
    """Hits of all channels as one list: units, files and symbols, by score and then by kind and place."""
    u = _merged(spark, d).join(_callables(spark, d, "repo", "path"), "unit_id")
    rows = u.select(F.lit("unit").alias("type"), "repo", "path", F.col("unit_id").alias("id"), "score")
    rows = rows.unionByName(j20_files(spark, d).withColumn("type", F.lit("file")), allowMissingColumns=True)
    rows = rows.unionByName(j11_symbols(spark, d).withColumn("type", F.lit("symbol")), allowMissingColumns=True)
    return search.limited(rows, ["type", "repo", "path", "id"], 500).select("type", "repo", "path", "id", "score", "rank", "omitted")


def a18_locations(spark, d):
    """Every normalised name with the places where it stands, in order."""
    s = load(spark, d, "symbols").where("name IS NOT NULL").select(X.symbol_words(F.col("name")).alias("words"), "repo", "path", "start_line").distinct()
    # gathered by repository, so a name that is everywhere is no single cell
    return s.groupBy("words", "repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "start_line"))), lambda x: F.concat_ws(":", x.path, x.start_line)), ",").alias("places"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0].islower() and k.split("_")[0][1:].isdigit()}

_V = f"""v AS (SELECT embedding_key AS key, min(role) AS role, min(CAST(vector AS DOUBLE[])) AS vector FROM vectors WHERE profile_key = '{PROFILE}' AND len(vector) = 64
 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
 u AS (SELECT DISTINCT unit_id, channel, embedding_key AS key FROM unit_vectors WHERE profile_key = '{PROFILE}')"""
_HITS = f"""{_V}, s AS (SELECT q.key AS query_id, v.key, list_cosine_similarity(q.vector, v.vector) AS score FROM v q JOIN v ON q.role = 'query' AND q.key <> v.key WHERE score >= 0.3),
 h AS (SELECT query_id, unit_id, channel, round(score, 6) AS score FROM s JOIN u USING (key) QUALIFY row_number() OVER (PARTITION BY query_id, unit_id ORDER BY round(score, 6) DESC, channel) = 1),
 m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, query_id) = 1)"""
_C = "c AS (SELECT DISTINCT unit_id, repo, path, name, qualified_name, start_line, end_line, end_column, line_count, source, source_hash FROM callables)"
_CUR = "cur AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC) = 1)"


def _words(c: str) -> str:
    for a, b in ((r"([\p{Ll}\p{N}])(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"(\p{L})(\p{N})", r"\1 \2"), (r"(\p{N})(\p{L})", r"\1 \2"), (r"[^\p{L}\p{N}]+", " ")):
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return f"lower(trim({c}))"


def _bag(rows: str) -> str:
    """Words of (id, text) hashed to signed coordinates."""
    word = f"SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM ({rows})"
    return f"SELECT id, CAST('0x' || substr(md5(word), 1, 4) AS INTEGER) % 64 AS b, sum(CASE WHEN substr(md5(word), 5, 1) < '8' THEN 1 ELSE -1 END) AS w FROM ({word}) GROUP BY 1, 2 HAVING w <> 0"


_ASKED = " UNION ALL ".join(f"SELECT '{i}' AS id, '{t}' AS text" for i, t in enumerate(TEXTS))


def _near(rows: str, low: float) -> str:
    """(id, score): best cosine of a text to the query texts."""
    return f"""q AS ({_bag(_ASKED)}), b AS ({_bag(rows)}), qn AS (SELECT id, sum(w * w) AS n FROM q GROUP BY 1), bn AS (SELECT id, sum(w * w) AS n FROM b GROUP BY 1),
 near AS (SELECT id, max(score) AS score FROM (SELECT b.id, q.id AS qid, sum(q.w * b.w) / sqrt(any_value(qn.n) * any_value(bn.n)) AS score FROM q JOIN b ON q.b = b.b JOIN qn ON qn.id = q.id JOIN bn ON bn.id = b.id GROUP BY 1, 2) WHERE score >= {low} GROUP BY 1)"""


_NAMES = f"n AS (SELECT DISTINCT repo, path, id, list_concat([{_words('name')}], list_transform(coalesce(names, []), lambda x: {_words('x')})) AS spellings FROM symbols WHERE name IS NOT NULL)"
_VOCAB = "SELECT w AS id, w AS text FROM (SELECT DISTINCT unnest(spellings) AS w FROM n)"
_EXCL = "x AS (SELECT DISTINCT lower(source_hash) AS source_hash FROM c JOIN (SELECT DISTINCT repo, path, name AS symbol FROM c WHERE regexp_matches(name, '^(load|merge)')) s USING (repo, path) WHERE qualified_name = symbol OR (name = symbol AND NOT EXISTS (SELECT 1 FROM c o WHERE o.repo = c.repo AND o.path = c.path AND o.qualified_name = symbol)))"
_CROSS = f"""{_V}, {_C}, {_EXCL}, k AS (SELECT unit_id, min(key) AS key FROM u WHERE channel = 'code' GROUP BY 1),
 r AS (SELECT c.*, repo || '/' || path AS file, vector FROM c JOIN k USING (unit_id) JOIN v USING (key) WHERE line_count >= 2 AND line_count < 200 AND source_hash NOT IN (SELECT source_hash FROM x)),
 t AS (SELECT a.unit_id AS a, b.unit_id AS b, a.file AS fa, b.file AS fb, list_cosine_similarity(a.vector, b.vector) AS score FROM r a JOIN r b ON a.unit_id % 20 = 0 AND a.file <> b.file WHERE score >= 0.8
   QUALIFY row_number() OVER (PARTITION BY a.unit_id ORDER BY score DESC, b.unit_id) <= 5),
 p AS (SELECT a, b, fa, fb, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY a) = 1)"""
_BIG = "big AS (SELECT repo FROM c GROUP BY 1 ORDER BY count(*) DESC, repo LIMIT 1)"

ORACLES = {
    "j2_delta": f"""WITH {_V}, t AS (SELECT q.key AS query_id, v.key AS id, list_cosine_similarity(q.vector, v.vector) AS score FROM v q JOIN v ON q.role = 'query' AND v.role = 'document' WHERE NOT (v.key LIKE '00%'))
 SELECT query_id, id, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""",
    "u1_union": f"""WITH {_HITS}, {_CUR}, {_NAMES}, a AS (WITH {_near('SELECT DISTINCT description AS id, description AS text FROM cur WHERE description IS NOT NULL', 0.3)} SELECT * FROM near), b AS (WITH {_near(_VOCAB, 0.3)} SELECT * FROM near),
 r AS (SELECT 'unit' AS type, repo, path, CAST(unit_id AS BIGINT) AS id, score FROM m JOIN (SELECT DISTINCT unit_id, repo, path FROM callables) USING (unit_id)
 UNION ALL SELECT 'file', repo, path, NULL, round(score, 6) FROM cur JOIN a ON a.id = description UNION ALL SELECT 'symbol', repo, path, n.id, round(max(score), 6) FROM (SELECT repo, path, id, unnest(spellings) AS w FROM n) n JOIN b ON b.id = w GROUP BY repo, path, n.id)
 SELECT type, repo, path, id, score, CAST(row_number() OVER (ORDER BY score DESC, type, repo, path, id NULLS FIRST) AS INTEGER) AS rank, count(*) OVER () > 500 AS omitted FROM r QUALIFY rank <= 500""",
    "a18_locations": f"SELECT words, repo, string_agg(path || ':' || start_line, ',' ORDER BY path, start_line) AS places FROM (SELECT DISTINCT {_words('name')} AS words, repo, path, start_line FROM symbols WHERE name IS NOT NULL) GROUP BY 1, 2",
    "j1_search": f"WITH {_HITS} SELECT query_id, unit_id, channel, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) > 20 AS omitted FROM h QUALIFY rank <= 20",
    "a7_search": f"WITH {_HITS} SELECT query_id, unit_id, channel, score, CAST(row_number() OVER (ORDER BY score DESC, unit_id) AS INTEGER) AS rank, count(*) OVER () > 200 AS omitted FROM m QUALIFY rank <= 200",
    "a20_by_file": f"WITH {_HITS}, {_C} SELECT repo, path, max(score) AS best, count(*) AS n_hits FROM m JOIN (SELECT DISTINCT unit_id, repo, path FROM c) USING (unit_id) GROUP BY 1, 2",
    "f24_expanded": f"WITH {_HITS} SELECT unit_id, path, start_line, score, CAST(strlen(source) AS INTEGER) AS n_bytes FROM m JOIN (SELECT DISTINCT unit_id, path, start_line, source FROM callables) USING (unit_id) WHERE score > 0.9",
    "j6_components": f"""WITH {_V}, a AS (SELECT unit_id, min(key) AS key FROM u WHERE channel = 'code' GROUP BY 1), b AS (SELECT unit_id, min(key) AS key FROM u WHERE channel = 'descriptions' GROUP BY 1)
 SELECT a.unit_id, coalesce(round(list_cosine_similarity(x.vector, y.vector), 6), 0) AS score FROM a LEFT JOIN b USING (unit_id) LEFT JOIN v x ON x.key = a.key LEFT JOIN v y ON y.key = b.key""",
    "j20_files": f"WITH {_CUR}, {_near('SELECT DISTINCT description AS id, description AS text FROM cur WHERE description IS NOT NULL', 0.3)} SELECT repo, path, round(score, 6) AS score FROM cur JOIN near ON near.id = description",
    "j11_symbols": f"WITH {_NAMES}, {_near(_VOCAB, 0.3)} SELECT repo, path, n.id, round(max(score), 6) AS score FROM (SELECT repo, path, id, unnest(spellings) AS w FROM n) n JOIN near ON near.id = w GROUP BY 1, 2, 3",
    "f7_semantic": f"""WITH {_NAMES}, {_near(_VOCAB, 0.5)} SELECT DISTINCT repo, path, id, name FROM symbols WHERE name IS NOT NULL AND kind IN ('function','method','constructor','generator') AND NOT regexp_matches(path, '^(.*/)?tests/')
 AND (regexp_matches(name, '^(load|fetch)') OR {_words('name')} IN (SELECT id FROM near))""",
    "f9_nodes": r"""SELECT DISTINCT repo, path, id, qualified_name FROM symbols WHERE kind IN ('function','method','constructor','generator','constant','variable') AND (regexp_matches(qualified_name, '(^|\.)(load|fetch)\w*$')
 OR len(list_filter(names, lambda n: regexp_matches(regexp_extract(qualified_name, '^(.*\.)?[^.]*$', 1) || n, '(^|\.)(load|fetch)\w*$'))) > 0)""",
    "f10_units": """WITH j AS (SELECT c.unit_id, arg_min(s.id, (abs(s.start_line - c.start_line), abs(s.start_column - c.start_column), s.id)) AS id FROM callables c JOIN symbols s ON c.repo = s.repo AND c.path = s.path AND c.name = s.name
 AND s.start_line <= c.end_line AND s.end_line >= c.start_line GROUP BY 1), s AS (SELECT repo, path, id, max(qualified_name) AS declared FROM symbols GROUP BY 1, 2, 3)
 SELECT DISTINCT unit_id FROM callables c LEFT JOIN j USING (unit_id) LEFT JOIN s ON s.repo = c.repo AND s.path = c.path AND s.id = j.id WHERE regexp_matches(coalesce(declared, qualified_name, name), '(?i)merge|split')""",
    "f11_files": f"WITH {_CUR} SELECT repo, path FROM cur WHERE path LIKE '%.py' AND NOT regexp_matches(path, '^(.*/)?tests/') AND regexp_matches(path, 'index|route')",
    "t6_reranked": f"""WITH {_HITS}, t AS (SELECT unit_id, score, row_number() OVER (ORDER BY score DESC, unit_id) AS i, source FROM m JOIN (SELECT DISTINCT unit_id, source FROM callables) USING (unit_id) QUALIFY i <= 100),
 r AS (SELECT unit_id, score AS similarity, i, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(source), '\\s+')), string_split('{TEXTS[0]}', ' '))) AS DOUBLE) AS rerank_score FROM t)
 SELECT unit_id, similarity, rerank_score, CAST(row_number() OVER (ORDER BY rerank_score DESC, i) AS INTEGER) AS rank FROM r QUALIFY rank <= 20""",
    "a10_inspect": rf"""WITH {_HITS}, e AS (SELECT DISTINCT unit_id, path FROM callables WHERE regexp_matches(concat_ws(chr(10), path, name, source), '(?m)^(def|func|fn) \w*(load|merge)')),
 a AS (SELECT unit_id, path, coalesce(m.score, -1) AS score FROM e LEFT JOIN m USING (unit_id)) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, unit_id) AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY path, unit_id) AS INTEGER) AS original FROM a""",
    "f25_exclusions": f"WITH {_C}, {_EXCL} SELECT source_hash FROM x",
    "x5_units": "SELECT DISTINCT embedding_key, true AS unit FROM vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0",
    "j4_files": f"""WITH {_CROSS}, f AS (SELECT *, string_split(fa, '/')[:-2] AS x, string_split(fb, '/')[:-2] AS y FROM p)
 SELECT a, b, score, CAST(1 + len(x) + len(y) - 2 * len(list_filter(range(1, 1 + least(len(x), len(y))), lambda i: x[1:i] = y[1:i])) AS INTEGER) AS distance FROM f""",
    "a5_ranked": f"""WITH RECURSIVE {_CROSS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT a AS id, a AS x FROM e UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.x), g AS (SELECT id, min(x) AS component FROM w GROUP BY 1),
 l AS (SELECT component, repo, path, start_line, name, greatest(coalesce(CASE WHEN end_column = 1 THEN end_line - 1 ELSE end_line END, start_line), start_line) AS last_line FROM g JOIN c ON c.unit_id = g.id),
 n AS (SELECT component, CAST(count(*) AS BIGINT) AS lines FROM (SELECT DISTINCT component, repo, path, unnest(range(start_line, last_line + 1)) FROM l) GROUP BY 1),
 z AS (SELECT component, count(*) AS members, min(concat_ws(':', repo, path, start_line, name)) AS label FROM l GROUP BY 1), y AS (SELECT component, min(score) AS low, max(score) AS high FROM p JOIN g ON g.id = p.a GROUP BY 1)
 SELECT members, low, high, lines, round(high * lines, 6) AS rank, label FROM z JOIN y USING (component) JOIN n USING (component) ORDER BY rank DESC, high DESC, lines DESC, label LIMIT 100""",
    "j5_indexes": f"""WITH {_V}, c AS (SELECT DISTINCT unit_id, repo FROM callables), {_BIG}, k AS (SELECT unit_id, min(key) AS key FROM u WHERE channel = 'code' GROUP BY 1), r AS (SELECT c.unit_id, c.repo, vector FROM c JOIN k USING (unit_id) JOIN v USING (key))
 SELECT query_id, id, round(score, 6) AS score FROM (SELECT a.unit_id AS query_id, b.unit_id AS id, list_cosine_similarity(a.vector, b.vector) AS score FROM r a JOIN r b ON a.unit_id % 20 = 0 AND a.repo = (SELECT repo FROM big) AND b.repo <> (SELECT repo FROM big)
 WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY a.unit_id ORDER BY score DESC, b.unit_id) <= 5)""",
    "f19_changed": f"""WITH {_C}, {_BIG}, b AS (SELECT DISTINCT qualified_name, source_hash FROM c WHERE repo = (SELECT repo FROM big))
 SELECT DISTINCT unit_id FROM c WHERE repo <> (SELECT repo FROM big) AND qualified_name IN (SELECT qualified_name FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.qualified_name = c.qualified_name AND b.source_hash = c.source_hash)""",
}
