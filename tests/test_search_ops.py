import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.functions.vectors import HashVector, cosine, embed_table, unit_length
from strataloom.operators import callgraph, kb, knn, outline, render, search, units


def test_limits_and_plans():
    assert search.resolved_limit() == 4096 and search.resolved_limit(5, 7) == 5 and search.resolved_limit(None, "7") == 7
    assert search.resolved_limit("none", 7) is None and search.resolved_limit("off") is None
    for bad in (0, -1, "x"):
        with pytest.raises(ValueError):
            search.resolved_limit(bad)
    assert search.channel_plan() == list(search.CHANNELS) and search.channel_plan(docs=True) == ["docs"] and "code" not in search.channel_plan(code=False)
    assert search.format_groups(None) == ["code", "docs"] and search.format_groups(["all"]) == list(X.GROUPS) and search.format_groups([" Config "]) == ["config"]
    for bad in ([], ["what"], [" "]):
        with pytest.raises(ValueError):
            search.format_groups(bad)
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises(Exception):
            search.Selection(patterns=[bad])
    assert search.kinds(["type", "X"]) == ["class", "enum", "interface", "struct", "trait", "type", "union", "x"]
    assert search.rerank_budget(10, True) == 50 and search.rerank_budget(None, False) == 100 and search.rerank_budget(500, False) == 100


def test_selection(spark):
    df = spark.createDataFrame([("a/x.py", "loadOne", ["one"], "load one"), ("a/y.md", "other", None, "other"), ("tests/x.py", "save", ["load"], "save"), (None, None, None, None)], "path string, name string, names array<string>, words string")
    sel = search.Selection(paths=["**/*.py", "!tests/**"], groups=["code"], patterns=["^LOAD"], ignore_case=True)
    assert [r.path for r in df.where(sel.files(F.col("path"))).collect()] == ["a/x.py"]
    assert [r.name for r in df.where(sel.named(F.col("name"), aliases=F.col("names"))).collect()] == ["loadOne", "save"]
    none = spark.createDataFrame([], "words string")
    meant = spark.createDataFrame([("other",), ("other",)], "words string")
    both = search.Selection(patterns=["^load"], semantic=meant)
    assert {r.name for r in both.apply(df, both.named(F.col("name")), "words").collect()} == {"loadOne", "other"}
    closed = search.Selection(semantic=none)
    assert closed.apply(df, closed.named(F.col("name")), "words").count() == 0
    assert search.Selection().apply(df, F.lit(True), "words").count() == 4


def hits(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "key string, vector array<double>")
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], "query_id string, vector array<double>")
    u = spark.createDataFrame([(1, "code", "a"), (1, "docs", "b"), (2, "docs", "b"), (3, "code", "c"), (4, "code", "z"), (5, "code", "a"), (6, "code", "gone")], "unit_id long, channel string, key string")
    return search.unit_hits(q, u, v, 0.7)


def test_merge_of_queries(spark):
    h = hits(spark)
    assert {(r.query_id, r.unit_id, r.channel, r.score) for r in h.collect()} == {("q1", 1, "code", 1.0), ("q1", 5, "code", 1.0), ("q1", 2, "docs", 0.8), ("q2", 3, "code", 1.0)}
    one = search.merged(h, ["unit_id"], ["query_id"])
    top = search.limited(one, ["unit_id"], 3).orderBy("rank").collect()
    assert [(r.unit_id, r["rank"], r.omitted) for r in top] == [(1, 1, True), (3, 2, True), (5, 3, True)]
    assert not any(r.omitted for r in search.limited(one, ["unit_id"], 4).collect()) and search.limited(one, ["unit_id"], None).count() == 4
    per = search.limited(h, ["unit_id"], 1, ["query_id"]).collect()
    assert {(r.query_id, r.unit_id, r.omitted) for r in per} == {("q1", 1, True), ("q2", 3, False)}
    assert search.limited(one.limit(0), ["unit_id"], 3).count() == 0


def test_rerank(spark):
    h = spark.createDataFrame([(1, 0.9, "x"), (2, 0.8, "y"), (3, 0.7, None)], "unit_id long, score double, text string")
    out = search.reranked(h, "q", "text", lambda q, docs: [(2, 5.0), (0, 1.0), (1, 5.0)], ["unit_id"], 2).orderBy("rank").collect()
    assert [(r.unit_id, r.rerank_score) for r in out] == [(2, 5.0), (3, 5.0)]
    for bad in ([(0, 1.0)], [(0, 1.0), (0, 1.0), (1, 1.0)], [(0, 1.0), (1, 1.0), (5, 1.0)]):
        with pytest.raises(ValueError):
            search.reranked(h, "q", "text", lambda q, docs, b=bad: b, ["unit_id"], 2)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0], [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, [1e-38, 0.0], [1e-38, 0.0])], "i int, a array<double>, b array<double>")
    got = {r.i: (r.c, r.u) for r in df.select("i", cosine(F.col("a"), F.col("b")).alias("c"), unit_length(F.col("a"), 2).alias("u")).collect()}
    assert round(got[1][0], 9) == 0.96 and got[2] == (0.0, None) and got[3] == (0.0, None) and got[4] == (0.0, None)
    assert [round(x, 6) for x in got[1][1]] == [0.6, 0.8] and got[5][1] == [1.0, 0.0]
    t = spark.createDataFrame([("k", "load the load"), ("e", ""), ("n", None), (None, "x")], "k string, t string")
    e = {r.key: r.vector for r in embed_table(t, "k", "t", HashVector(8, 1)).collect()}
    assert set(e) == {"k", None} and sum(abs(x) for x in e["k"]) in (1.0, 3.0)

    class Short(HashVector):
        def embed(self, inputs, query=False):
            return super().embed(inputs)[:, :3]

    with pytest.raises(Exception):
        embed_table(t, "k", "t", Short(8)).collect()
    rows = spark.createDataFrame([("a", [1.0, 0.0], "f"), ("b", [0.9, 0.1], "f"), ("c", [0.5, 0.5], "g"), ("d", [0.0, 0.0], "g")], "id string, vector array<double>, file string")
    got = [(r.query_id, r.id) for r in knn.nearest(rows.where("id = 'a'").withColumnRenamed("id", "query_id"), rows, 1, -1, apart="file").collect()]
    assert got == [("a", "c")]
    assert knn.nearest(rows.where("id = 'a'").withColumnRenamed("id", "query_id"), rows, None, -1).count() == 3


def test_units_and_exclusions(spark):
    u = spark.createDataFrame([("r", "a", "x", "A.x", "H1"), ("r", "a", "x", "x", "h2"), ("r", "b", "x", "B.x", "h3"), ("r", "b", "x", "C.x", None)], "repo string, path string, name string, qualified_name string, source_hash string")
    s = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x"), ("r", "c", "x")], "repo string, path string, symbol string")
    assert {r.source_hash for r in search.excluded_hashes(s, u).collect()} == {"h2", "h3", None}
    units_ = spark.createDataFrame([("load it",), ("load it",), ("save",), (None,), ("!!",)], "input string")
    empty = spark.createDataFrame([], "embedding_key string, profile_key string, vector array<double>")
    made = units.embedded(units_, empty, HashVector(16))
    assert made.count() == 2
    assert units.embedded(units_, made, HashVector(16)).count() == 0 and units.embedded(units_, made, HashVector(32)).count() == 2
    assert units.associated(units_, made, "words-16").where("embedding_key IS NULL").count() == 2


def test_outline(spark):
    n = [("f", 1, None, "a", 1, 9, None, True), ("f", 2, 1, "b", 2, 3, None, True), ("f", 3, 1, "c", 5, 6, None, True), ("f", 4, 1, "d", 7, 7, None, False), ("f", 5, 1, "e", 8, 8, None, True), ("f", 6, 1, "h", 30, 31, None, True)]
    df = spark.createDataFrame(n, "path string, id int, parent_id int, name string, start_line int, end_line int, heading_level int, chosen boolean")
    assert {(r.id, r.hunk) for r in outline.hunks(df, ["path"], "chosen").collect()} == {(1, 0), (2, 0), (3, 0), (5, 1), (6, 2)}
    assert {r.id for r in outline.closure(df, df.where("id = 5"), ["path"]).collect()} == {1, 5}
    up = outline.inherited(df.withColumn("p", F.col("id") == 1), ["path"], "p", F.lit(True))
    assert all(r.p for r in up.collect())
    up = outline.inherited(df.withColumn("p", F.col("id") == 1), ["path"], "p", F.lit(False))
    assert {r.id for r in up.where("p").collect()} == {1}
    h = spark.createDataFrame([("f", i, t, i, lv) for i, (t, lv) in enumerate([("A", 1), ("B", 3), ("C", 2), ("D", 3), ("E", 1), ("F", 4)], 1)], "path string, id int, name string, start_line int, heading_level int")
    assert {r.id: "/".join(r.heading_path) for r in outline.heading_paths(h, ["path"]).collect()} == {1: "A", 2: "A/B", 3: "A/C", 4: "A/C/D", 5: "E", 6: "E/F"}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 1)], "src long, dst long")
    s = spark.createDataFrame([(1,), (3,), (3,), (9,)], "id long")
    assert {(r.seed, r.id, r.depth) for r in outline.reach_each(e, s, 2).collect()} == {(1, 2, 1), (1, 3, 2), (3, 1, 1), (3, 4, 1), (3, 2, 2)}
    assert "1-9" in render.hunks(outline.hunks(df, ["path"], "chosen").withColumn("signature", F.lit(None).cast("string")))


def test_calls(spark):
    from strataloom.extract.tables import extracted, kind_of

    files = {
        "pkg/a.py": "from pkg.b import middle as m\nfrom . import c\n\ndef outer():\n    m()\n    c.leaf()\n    twice()\n    Box()\n\ndef rec():\n    rec()\n\nclass Box:\n    def __init__(self):\n        self.fill()\n    def fill(self):\n        fill()\n",
        "pkg/b.py": "def middle():\n    deepest()\n\ndef deepest():\n    pass\n",
        "pkg/c.py": "def leaf():\n    pass\n\ndef twice():\n    pass\n",
    }
    t = spark.createDataFrame([("r", p, "python", x) for p, x in files.items()], "repo string, path string, language string, source string")
    rows = extracted(t, "path")
    of = lambda what: t.select("repo", "path", "language").join(kind_of(rows, what), F.col("path") == F.col("key")).drop("key")
    got = callgraph.resolved_calls(of("declaration"), of("call"), of("import"))
    name = of("declaration").select("path", "id", "name")
    got = got.join(name.toDF("src_path", "src_id", "caller"), ["src_path", "src_id"]).join(name.toDF("dst_path", "dst_id", "callee"), ["dst_path", "dst_id"])
    assert {(r.caller, r.callee) for r in got.collect()} == {("outer", "middle"), ("outer", "leaf"), ("outer", "__init__"), ("rec", "rec"), ("__init__", "fill"), ("middle", "deepest")}
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d"), ("r", "x", "a")], "repo string, src_path string, dst_path string")
    assert {r.path for r in callgraph.import_cycles(e).collect()} == {"a", "b", "c"}


def test_articles(spark):
    a = spark.createDataFrame([("r", "kb/x.md", "See `src/a.py:2-3` and (src/a.py#L2-L3), [it](../src/a.py#go \"t\") or `src/b.py`.\n```\n[no](../src/a.py)\n```\n[out](https://x.y) [abs](/src/a.py)"), ("r", "n.md", None)], "repo string, path string, source string")
    refs = kb.references(a)
    assert {(r.path, r.start_line, r.end_line) for r in refs.collect()} >= {("src/a.py", 2, 3), ("src/b.py", None, None)}
    old = spark.createDataFrame([("r", "src/a.py", "1\n2\n3\n4\n"), ("r", "src/b.py", "x\ny\n")], "repo string, path string, source string")
    lines = refs.where("start_line IS NOT NULL")
    outside = spark.createDataFrame([("r", "src/a.py", "0\n1\n2\n3\n5\n")], old.schema)
    inside = spark.createDataFrame([("r", "src/a.py", "1\n2\nchanged\n4\n")], old.schema)
    ratio = lambda new: kb.cited_freshness(lines, old, new).first().ratio
    assert ratio(outside) == 1.0 and ratio(inside) == 0.5 and ratio(old.limit(0)) == 0.0
    s = spark.createDataFrame([("r", "p", 0.9), ("r", "q", 0.95), ("r", "p", 0.5)], "repo string, path string, score double")
    f = spark.createDataFrame([("r", "q", 0.1)], "repo string, path string, ratio double")
    assert [r.path for r in kb.ranked_articles(s, f, ["repo", "path"], 0.5).collect()] == ["p"]
    moves = spark.createDataFrame([("r", "src/a.py", "lib/c d.py")], "repo string, path string, new_path string")
    assert [(r.path, r.old_link, r.new_link) for r in kb.moved_links(a, moves).collect()] == [("kb/x.md", "../src/a.py#go", "../lib/c%20d.py#go")]
    own = spark.createDataFrame([("r", "kb/x.md", "deep/er/x.md")], moves.schema)
    assert [r.new_link for r in kb.moved_links(a, own).collect()] == ["../../src/a.py#go"]


def test_text_functions(spark):
    one = lambda f, *v: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, a string").orderBy("i").select(f(F.col("a"))).collect()]
    assert one(X.percent_encoded, "a b/c+d~*é.md") == ["a%20b/c%2Bd~%2A%C3%A9.md"] and one(X.percent_decoded, "a%20b+c", "bad%zz", None) == ["a b+c", "bad%zz", None]
    assert one(lambda c: X.truncate_bytes(c, 4), "abcdef", "aéé", "éé字", "a😀b", "ab", None) == ["abcd", "aé", "éé", "a", "ab", None]
    assert one(X.comment_prose, "/**\n * A b.\n *\n * c\n */", "// x\n// y", "# z", '"""doc"""', None) == ["A b.\n\nc", "x\ny", "z", "doc", None]
    assert one(X.decoded_key, '"a\\u0041\\n"', "'it''s'", "plain", None) == ["aA\n", "it's", "plain", None]
    assert one(X.normal_path, "a//b/./c/", "a\\b", "a/../b", "../a", None) == ["a/b/c", "a/b", "b", None, None]
    assert one(lambda c: X.closest(c, ["load", "fetch"], 2), "laod", "fetches", "zzzz", None) == ["load", "fetch", None, None]
    assert one(X.unfenced_json, '```json\n{"a": 1}\n```', " {} ", None) == ['{"a": 1}', "{}", None]
    paths = spark.createDataFrame([(["a/b/c", "a/b/d/e", "a/b"],), (["x"],), (["a/b", "c"],), (["ab/c", "a/c"],)], "p array<string>")
    assert [r[0] for r in paths.select(X.common_parent(F.col("p"))).collect()] == ["a", "", "", ""]
