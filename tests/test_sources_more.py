import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from strataloom import options
from strataloom.engine import Engine, unindexed
from strataloom.operators import describe, knn
from strataloom.sources import git
from strataloom.sources.tree import export_json_array, read_subset
from strataloom.streaming import usage


def run(root, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env).stdout.decode().strip()


def test_git(spark, tmp_path):
    assert git.changes(str(tmp_path), "x") is None
    run(tmp_path, "init", "-q")
    for name, text in (("a.py", "one\n"), ("b.py", "two\n"), ("c.py", "three\n")):
        (tmp_path / name).write_text(text)
    run(tmp_path, "add", "-A")
    run(tmp_path, "commit", "-qm", "one")
    first = run(tmp_path, "rev-parse", "HEAD")
    (tmp_path / "b.py").write_text("new\n")
    run(tmp_path, "commit", "-qam", "two")
    (tmp_path / "a.py").write_text("dirty\n")
    (tmp_path / "é.py").write_text("x\n")
    got = git.changes(str(tmp_path), first)
    assert got.dirty == ["a.py", "é.py"] and got.changed == ["b.py"] and git.changes(str(tmp_path), "0" * 40) is None and git.changes(str(tmp_path), None) is None
    # a path that was dirty before stays a candidate, so a restored file is seen
    assert git.candidates(got, ["c.py"]) == ["a.py", "b.py", "c.py", "é.py"] and git.candidates(None, ["c.py"]) is None
    base = {r.path: r.source for r in git.base_files(spark, str(tmp_path), first, "r", ["b.py", "none.py"]).collect()}
    assert base == {"b.py": "two\n"}
    assert {(r.path, r.source_mode) for r in git.source_modes(spark, "r", got, ["a.py", "c.py"]).collect()} == {("a.py", "working-tree"), ("c.py", "git")}


def test_options():
    o = options.loaded('{"minLines": 3, "exclude": ["x"], "exclude-hashes": ["%s"]}' % ("a" * 64), options.Options(exclude_hashes=("b" * 64,)))
    assert o.min_lines == 3 and o.exclude == ("x",) and o.exclude_hashes == ("a" * 64, "b" * 64)
    with pytest.raises(ValueError, match="did you mean matches"):
        options.loaded('{"matchs": 1}')
    for bad in ("[]", '{"matches": 0}', '{"min_similarity": 3}', '{"excludeHashes": ["A"]}', '{"zzzzzzzz": 1}', " " * (2 << 20)):
        with pytest.raises(ValueError):
            options.loaded(bad)


def test_conversations(spark):
    class Echo:
        profile = "echo"

        def describe(self, messages):
            if messages[-1] == "bad":
                raise ValueError("no")
            return f"{messages[0]}:{len(messages)}:{messages[-1]}" if messages[-1] else None

    rows = [("r", "a", 2, 5, "second"), ("r", "a", 1, 1, "first"), ("r", "a", 3, 9, "bad"), ("r", "a", 4, 12, "last"), ("r", "b", 5, 1, None)]
    u = spark.createDataFrame(rows, "repo string, path string, unit_id long, start_line int, input string")
    got = {r.unit_id: r.description for r in describe.conversations(u, Echo()).collect()}
    assert got == {1: "a:2:first", 2: "a:4:second", 4: "a:8:last"}
    assert {r.unit_id: r.description for r in describe.conversations(u, Echo(), max_units=1).collect()}[2] == "a:2:second"
    done, told = [], []
    assert describe.in_batches(u, lambda df: df.select("unit_id"), lambda df: done.extend(r.unit_id for r in df.collect()), "unit_id", 3, lambda n, of: told.append((n, of))) == 3
    assert sorted(done) == [1, 2, 3, 4, 5] and told == [(1, 3), (2, 3), (3, 3)]


def test_delta(spark):
    v = lambda rows: spark.createDataFrame(rows, "id long, vector array<double>")
    base = v([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.01])])
    delta = v([(3, [1.0, 0.0]), (9, [0.5, 0.5])])
    q = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, vector array<double>")
    got = [r.id for r in knn.with_delta(q, base, delta, v([(1, [0.0, 0.0])]), 3).orderBy(F.desc("score"), "id").collect()]
    assert got == [3, 4, 2]


def test_exports_and_trees(spark, tmp_path):
    tree = tmp_path / "t"
    (tree / "src").mkdir(parents=True)
    (tree / "src" / "a.py").write_text("import os\n# x\ndef f():\n    g()\n")
    (tree / "b.md").write_text("# T\n")
    files, _ = read_subset(spark, str(tree), "r", spark.createDataFrame([("src",), ("src/a.py",)], "path string"))
    assert [r.path for r in files.collect()] == ["src/a.py"]
    t = unindexed(spark, str(tree), "r")
    assert [r.name for r in t["declarations"].where("kind <> 'heading'").collect()] == ["f"] and t["calls"].count() == 1 and t["imports"].count() == 1 and t["spans"].count() == 1
    export_json_array(files.select("path"), str(tmp_path / "x.json"), 5)
    assert json.loads((tmp_path / "x.json").read_text()) == [{"path": "src/a.py"}]
    with pytest.raises(ValueError):
        export_json_array(spark.range(3), str(tmp_path / "y.json"), 2)
    e = Engine(spark, str(tmp_path / "i"))
    e.refresh(str(tree), "r")
    first = [r.unit_id for r in e.cached_search(["f os"], 5, -1.0).collect()]
    assert first == [r.unit_id for r in e.cached_search(["f os"], 5, -1.0).collect()] and len(first) >= 1


def test_usage_log(spark, tmp_path):
    root = str(tmp_path / "u")
    usage.record(spark, root, [("search", True, 5, 2), ("search", False, 1, 0)])
    usage.record(spark, root, [("map", True, 3, 1)])
    daily, total = usage.history(spark, root)
    assert {(r.command, r.runs, r.succeeded, r.results) for r in total.collect()} == {("search", 2, 1, 2), ("map", 1, 1, 1)} and daily.count() == 2
