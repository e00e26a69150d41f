import datetime as dt

from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import graph, intervals, knn, lines, sections, snapshots
from strataloom.operators.freshness import freshness
from strataloom.sources import current_files
from strataloom.sources.tree import export_csv, read_tree
from strataloom.streaming import usage


def col(spark, expr, *rows):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(expr).collect()]


def test_text(spark):
    assert col(spark, X.symbol_words(F.col("a")), ("parseHTTPServer2x", ""), ("snake_Case", ""), (None, ""), ("", "")) == ["parse http server 2 x", "snake case", None, ""]
    assert col(spark, X.path_distance(F.col("a"), F.col("b")), ("x/a", "x/a"), ("x/a", "x/b"), ("x/y/a", "x/b"), ("a", "p/q/b")) == [0, 1, 2, 3]
    globs = ["*.py", "!sub/**", "sub/keep.py"]
    assert col(spark, X.ordered_globs(F.col("a"), globs), ("a.py", ""), ("d/a.py", ""), ("sub/x.py", ""), ("sub/keep.py", ""), (None, "")) == [True, False, False, True, False]
    assert col(spark, X.slug(F.col("a")), ("Hello, World!", "")) == ["hello-world"]
    assert col(spark, X.concise(F.col("a"), 5), ("a  b\nc d", ""), ("abc", "")) == ["a b …", "abc"]


def test_ranges(spark):
    # nested, touching, apart, another file, repeats, reversed and null
    rows = [("f", 1, 10), ("f", 3, 5), ("f", 8, 14), ("f", 20, 22), ("g", 1, 10), ("f", 1, 10), ("f", 9, 2), ("f", None, 4), ("f", 15, 15)]
    df = spark.createDataFrame(rows, "path string, s int, e int")
    assert {(r.path, r.lines) for r in intervals.covered_lines(df, ["path"], "s", "e").collect()} == {("f", 18), ("g", 10)}
    assert intervals.merge_ranges(df.limit(0), ["path"], "s", "e").count() == 0


def test_lines(spark):
    t = spark.createDataFrame([("a.py", "x = 1\n\n# c\ny = 2"), ("b.c", "#include <x>\r\n// c\r\n"), ("e", ""), ("n", None)], "path string, source string")
    got = {r.path: r for r in lines.line_totals(lines.line_rows(t.withColumn("t", F.lit(False)), ["path", "t"], "source"), ["path"], "t").collect()}
    assert (got["a.py"].lines, got["a.py"].blank, got["a.py"].comment, got["a.py"].code) == (4, 1, 1, 2)
    assert (got["b.c"].lines, got["b.c"].comment, got["b.c"].code) == (2, 1, 1) and set(got) == {"a.py", "b.c"}
    f = spark.createDataFrame([("r", "src/a", 7), ("r", "src/n/b", 20), ("r", "src/n/b", 3), ("r", "c", 5)], "repo string, path string, v int")
    assert {(r.folder, r.v) for r in lines.folder_rollup(f, ["repo"], "path", "v").collect()} == {("", 32), ("src", 27), ("src/n", 20)}


def test_nearest(spark):
    v = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1, 0), (0.8, 0.6), (0, 1), (1, 0), (2, 0)])], "id long, vector array<float>")
    q = v.where("id = 0").withColumnRenamed("id", "query_id")
    for block in (2, 4096):
        got = [(r.id, round(r.score, 6)) for r in knn.nearest(q, v, 3, 0.7, block=block).orderBy(F.desc("score"), "id").collect()]
        assert got == [(3, 1.0), (4, 1.0), (1, 0.8)]
    hits = spark.createDataFrame([(1, 0.5), (1, 0.9), (2, 0.9)], "id long, score double")
    assert [(r.id, r.score) for r in knn.best_of(hits, "id", 2).collect()] == [(1, 0.9), (2, 0.9)]
    p = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 3, 1.0)], "a long, b long, s double")
    assert [(r.a, r.b) for r in knn.one_direction(p, "a", "b", "s").collect()] == [(1, 2)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (None, 9)], "src long, dst long")
    s = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert {(r.id, r.depth) for r in graph.reach(e, s, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.id, r.component) for r in graph.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    n = spark.createDataFrame([("f", 1, None), ("f", 2, 1), ("f", 3, 2), ("f", 4, 1), ("g", 5, 6), ("g", 6, 5)], "p string, id int, parent_id int")
    m = spark.createDataFrame([("f", 3), ("g", 5)], "p string, id int")
    assert {(r.p, r.id) for r in graph.with_ancestors(n, m, ["p"]).collect()} == {("f", 1), ("f", 2), ("f", 3), ("g", 5), ("g", 6)}


def test_sections_and_files(spark):
    h = spark.createDataFrame([("f", 1, 1, 30), ("f", 5, 2, 30), ("f", 9, 3, 30), ("f", 20, 2, 30)], "p string, start int, level int, last int")
    got = {r.start: (r.body_end, r.section_end) for r in sections.section_ends(h, ["p"], "start", "level", "last").collect()}
    assert got == {1: (4, 30), 5: (8, 19), 9: (19, 19), 20: (30, 30)}
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([("r", "a", "new", t), ("r", "a", "old", t - dt.timedelta(1)), ("r", "a", "new", t), ("r", "b", "x", None)], "repo string, path string, hash string, indexed_at timestamp")
    assert {(r.path, r.hash) for r in current_files(f, ["hash"]).collect()} == {("a", "new"), ("b", "x")}


def test_snapshots(spark, tmp_path):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, h string")
    b = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "k string, h string")
    assert {(r.k, r.change) for r in snapshots.changes(a, b, ["k"], "h").collect()} == {("b", "edited"), ("d", "added")}
    old = spark.createDataFrame([("x", 3), ("y", 8)], "identity string, id long")
    now = spark.createDataFrame([("y",), ("z",), ("w",), ("w",), (None,)], "identity string")
    got = {r.identity: r.id for r in snapshots.reconcile_ids(old, now, "identity", "id").collect()}
    assert got["y"] == 8 and {got["z"], got["w"]} == {9, 10} and len(got) == 3
    one, two = (snapshots.table_digest(x, ["k", "h"]).first() for x in (a, a.orderBy(F.desc("k"))))
    assert one == two and one != snapshots.table_digest(b, ["k", "h"]).first()
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    assert store.publish({"t": a}) == 1 and store.publish({"t": b}, expected=1) == 2 and store.read("t").count() == 4
    try:
        store.publish({"t": a}, expected=1)
        raise AssertionError("a stale generation was accepted")
    except RuntimeError:
        pass


def test_usage(spark):
    t = dt.datetime(2024, 1, 1, 23, 0)
    e = spark.createDataFrame([(1, t, "a", 1.0), (1, t + dt.timedelta(hours=1.5), "a", 2.0), (1, None, "a", 9.0), (2, t, "b", None)], "user_id long, ts timestamp_ntz, event_type string, value double")
    assert {(str(r.day), r.event_type, r.n) for r in usage.daily_counts(e).collect()} == {("2024-01-01", "a", 1), ("2024-01-02", "a", 1), ("2024-01-01", "b", 1)}
    assert {(r.user_id, r.n) for r in usage.sessions(e, "user_id", "2 hours").collect()} == {(1, 2), (2, 1)}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_tree_and_export(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"src/a.py": b"x = 1\n", "b.md": "é".encode(), "bad.js": b"\xff\xfe", "big.c": b"x" * 50, "node_modules/c.js": b"1", "none.bin": b"1", "yarn.lock": b"1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    files, bad = read_tree(spark, str(root), "r", max_bytes=40)
    assert {(r.path, r.source) for r in files.collect()} == {("src/a.py", "x = 1\n"), ("b.md", "é"), ("bad.js", ""), ("big.c", "")}
    assert {r.path for r in bad.collect()} == {"bad.js", "big.c"}
    df = spark.createDataFrame([("a,b\"c", [1, 2], None)], "t string, l array<int>, n int")
    export_csv(df, str(tmp_path / "csv"))
    got = max((p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")), key=len)
    assert got == b't,l,n\r\n"a,b""c","[1,2]",\r\n'


def test_freshness(spark):
    df = spark.createDataFrame([("a", "1\n2\n3", "1\n3\n4\n5"), ("b", None, ""), ("c", "x", None)], "k string, o string, n string")
    assert {(r.k, r.same, r.lines, r.ratio) for r in freshness(df, ["k"], "o", "n").collect()} == {("a", 2, 4, 0.5), ("b", 0, 0, 1.0), ("c", 0, 1, 0.0)}
