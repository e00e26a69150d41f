from strataloom.operators.hierarchy import hierarchy

SCHEMA = "repo string, path string, id int, parent_id int, name string, depth int, root_id string"


def made():
    rows = [("r", "a", i, i - 1 if i else None, f"n{i}", 0, "x") for i in range(60)]  # a chain
    rows += [("r", "b", 1, None, "top", 0, "x"), ("r", "b", 2, 1, None, 0, "x"), ("r", "b", 3, 99, "lost", 0, "x"), ("r", "b", 3, 99, "lost", 1, "y")]
    rows += [("r", "c", 5, 6, "p", 0, "x"), ("r", "c", 6, 7, "q", 0, "x"), ("r", "c", 7, 5, "s", 0, "x"), ("r", "c", 8, 7, "below", 0, "x"), ("r", "c", 9, 8, "deep", 0, "x"), ("r", "c", 1, 1, "self", 0, "x")]
    rows += [(None, None, 1, None, "null group", 0, "x"), (None, None, 2, 1, "child", 0, "x"), ("r", "d", None, 1, "no id", 0, "x")]
    return rows


def check(spark, **how):
    df = spark.createDataFrame(made(), SCHEMA)
    h = hierarchy(df, ["repo", "path"], **how)
    n = {(r.path, r.id): r for r in h.nodes.collect()}
    assert len(n) == 60 + 3 + 2
    assert n[("a", 59)].depth == 59 and n[("a", 59)].root_id == 0 and n[("a", 59)].name_path == [f"n{i}" for i in range(60)]
    assert n[("b", 2)].name_path == ["top", None] and n[("b", 3)].depth == 0 and n[(None, 2)].root_id == 1
    assert {(r.id, r.cycle_id) for r in h.cyclic.collect()} == {(5, 5), (6, 5), (7, 5), (8, 5), (9, 5), (1, 1)}
    d = h.descendants().collect()
    assert len(d) == 60 * 59 // 2 + 1 + 1
    assert {(r.id, r.descendants) for r in h.descendant_counts().where("path = 'a'").collect()} == {(i, 59 - i) for i in range(60)}


def test_levels_and_strides(spark):
    check(spark, levels=2, stride=8)


def test_empty(spark):
    h = hierarchy(spark.createDataFrame([], SCHEMA), ["repo", "path"])
    assert h.nodes.count() == 0 and h.cyclic.count() == 0 and h.descendants().count() == 0
