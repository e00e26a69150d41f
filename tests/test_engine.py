import pytest

from strataloom.engine import Engine
from strataloom.operators.freshness import relocated, retained_lines
from strataloom.operators.snapshots import SnapshotStore


def test_refresh(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "node_modules").mkdir()
    (tree / "src" / "a.py").write_text("# Loads rows.\ndef load():\n    return 1\n\n\ndef save():\n    return 2\n")
    (tree / "b.md").write_text("# Title\n\nAbout loading.\n")
    (tree / "bad.py").write_bytes(b"\xff\xfe\x00")
    (tree / "node_modules" / "x.js").write_text("var a;")
    e = Engine(spark, str(tmp_path / "index"))
    first = e.refresh(str(tree), "r")
    assert (first.updated, first.deleted, first.functions) == (3, 0, 2) and first.prepared >= 3
    ids = {r.qualified_name: r.unit_id for r in e.store.read("units").collect()}
    assert {r.path for r in e.store.read("files").collect()} == {"src/a.py", "b.md", "bad.py"}
    assert [r.path for r in e.errors().collect() if r.code == "read"] == ["bad.py"]
    hit = e.search(["load rows"], 1).collect()
    assert [(h.qualified_name, h.omitted) for h in hit] in ([("load", True)], [("load", False)])
    # a file that could not be read stays a candidate; all else is unchanged
    assert e.refresh_structure(str(tree), "r").updated == 1
    (tree / "bad.py").unlink()
    (tree / "src" / "a.py").write_text("def save():\n    return 2\n\n\ndef merge(x):\n    return x\n")
    second = e.refresh(str(tree), "r")
    assert (second.updated, second.deleted) == (1, 1) and second.generation > first.generation
    after = {r.qualified_name: r.unit_id for r in e.store.read("units").collect()}
    assert after["save"] == ids["save"] and "load" not in after and after["merge"] not in ids.values()
    done = e.refresh(str(tree), "r")
    assert done.updated == done.deleted == done.prepared == 0 and done.generation == second.generation
    s = e.status().first()
    assert s.n_files == 2 and s.n_units == s.n_vectors


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    df = spark.range(3)
    assert store.current()["generation"] == 0 and not store.has("a")
    assert store.publish({"a": df}, 0) == 1 and store.publish({"b": df}, 1, {"x": 1}) == 2
    with pytest.raises(RuntimeError):
        store.publish({"a": df}, 1)
    # two writers of one generation: the second fails and leaves nothing
    other = SnapshotStore(spark, str(tmp_path / "s"))
    stale = store.current()
    other.publish({"a": spark.range(5)})
    store.current = lambda: stale
    with pytest.raises(RuntimeError):
        store.publish({"a": spark.range(9)})
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert again.read("a").count() == 5 and again.read("b").count() == 3 and again.current()["notes"] == {"x": 1}
    assert len(again.prune()) == 1 and again.read("a").count() == 5 and again.read("b").count() == 3


def test_retained_lines():
    assert retained_lines("a\nb\nc\nd", "x\nb\nd\nc\ny") == (2, 5) and retained_lines("", "") == (0, 0) and retained_lines("a\n" * 900 + "b", "a\n" * 800) == (800, 901)
    old = ["a", "b", "c", "d"]
    assert relocated(old, ["x", "a", "b", "c", "d"], 2, 3) == (3, 4) and relocated(old, ["a", "b", "new", "d"], 2, 4) == (2, 4) and relocated(old, ["z"], 1, 2) is None
