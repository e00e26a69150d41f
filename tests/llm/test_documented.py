import pytest

from strataloom.llm.documented import clean_lines, documented_callables, says_something, token_documents
from strataloom.llm.lex import CLASSES, lex


@pytest.mark.parametrize(
    "text,name,want",
    [
        ("// Keeps at most 9 trays in memory; older ones are written first.", "packTray", True),
        ("/** Clamps the slot. */", "clampSlot", False),
        ("# Description of merge_tray", "merge_tray", False),
        ("/**\n * @param {*} key\n * @returns\n */", "f", False),
        ("// @returns the list of trays in arrival order", "f", True),
        ("// eslint-disable-next-line no-eval", "f", False),
        ("// out = fetch(limit);", "fetch", False),
        ("# ------------", "f", False),
        ("// TODO: shorten.", "f", False),
        ("// TODO: shorten.\n// Blocks until the lock has been released.", "f", True),
        ("'''No description.'''", "f", False),
        ('"""A helper method."""', "f", False),
        ("Args:\n    owner:\nReturns:", "f", False),
        ("// Vacía la cola antes de cerrar el packet.", "f", True),
        ("/**\n *\n */", "f", False),
        (None, "f", False),
        ("", None, False),
        ("// Sorts entries by age, oldest first.", None, True),
    ],
)
def test_says(text, name, want):
    assert says_something(text, name) is want


def test_lexer():
    names = lambda t, lang: [CLASSES[k] if k < 64 else "KW" for k in lex(t, lang)[0]]
    assert names("if a:\n    b\n", "python") == ["KW", "IDENT", ":", "NEWLINE", "INDENT", "IDENT", "NEWLINE", "DEDENT"]
    assert names("x := 1 // c\ny", "go") == ["IDENT", "=", "NUM", "COMMENT", ";", "IDENT", ";"] or names("x := 1 // c\ny", "go")[:3] == ["IDENT", "=", "NUM"]
    assert names("a = b / c / d;", "javascript").count("BIN") == 2
    assert names("a = /[/]x/g.test(b)", "javascript")[2] == "STR"
    assert names("'a", "c")[-1] == "OPEN" and names("fn f<'a>() {}", "rust")[3] == "LIFE"
    assert clean_lines("/** x\n * y */") == ["x", "y"]


FILES = {
    "a.py": "# Top.\n\n# Walks the whole tree slowly.\ndef walk(a,\n         b):\n    '''Stops at the first leaf found.'''\n    if a:\n        return b\n\n\ndef bare(x):\n    return x\n",
    "b.js": "/**\n * Keeps older entries first in line.\n */\nexport function keep(a) {\n  a.forEach((x) => {\n    x.y();\n  });\n}\n\n// far away\n\nfunction far() {\n}\n",
    "c.go": "package c\n\n// Blocks until every reader has left.\nfunc Block(a int) int {\n\treturn a\n}\n",
    "d.rs": "/// Splits at borders, never inside.\nfn split(a: &'static str) -> i64 {\n    0\n}\n",
}


def test_pairs(spark):
    files = [("r", p, f"h{i}") for i, p in enumerate(FILES)] + [("r", "copy.py", "h0"), ("r", "none.py", "gone"), ("r", "x.unknown", "h1")]
    f = spark.createDataFrame(files, "repo string, path string, hash string")
    s = spark.createDataFrame([(f"h{i}", t, "x") for i, t in enumerate(FILES.values())] + [("h9", None, "x")], "hash string, source string, path string")
    c = [
        (1, "r", "a.py", "walk", 4), (1, "r", "a.py", "walk", 4), (2, "r", "a.py", "bare", 11), (3, "r", "b.js", "keep", 4), (4, "r", "b.js", "far", 12),
        (5, "r", "c.go", "Block", 4), (6, "r", "d.rs", "split", 2), (7, "r", "copy.py", "walk", 4), (8, "r", "none.py", "f", 1), (9, None, None, None, None), (10, "r", "x.unknown", "keep", 4),
    ]
    cs = spark.createDataFrame([(*x, "code", None) for x in c], "unit_id long, repo string, path string, name string, start_line int, source string, signature string")
    got = documented_callables(f, s, cs).collect()
    assert sorted(r.unit_id for r in got) == list(range(1, 11))
    assert {r.unit_id for r in got if r.says} == {1, 3, 5, 6, 7}
    assert next(r for r in got if r.unit_id == 1).description == "# Walks the whole tree slowly.\n'''Stops at the first leaf found.'''"
    texts = spark.createDataFrame([(p, {"py": "python", "js": "javascript", "go": "go", "rs": "rust"}[p[-2:]], t) for p, t in FILES.items()] + [("e", "python", ""), ("n", "python", None)], "id string, language string, source string")
    fn = {(r.id, r.name): (r.line, r.end_line) for r in token_documents(texts)[1].collect()}
    assert fn == {("a.py", "walk"): (4, 8), ("a.py", "bare"): (11, 12), ("b.js", "keep"): (4, 8), ("b.js", "far"): (12, 13), ("c.go", "Block"): (4, 6), ("d.rs", "split"): (2, 4)}
    assert documented_callables(f.limit(0), s.limit(0), cs.limit(0)).count() == 0


def test_markers_and_scripts():
    assert says_something("Note: callers must hold the lock", "run") and says_something("WARNING - drops pending rows", "run")
    assert not says_something("Note:", "run") and not says_something("NB!", "run") and not says_something("TODO: shorten.", "run")
    assert says_something("二つの値を足して返す", "run") and not says_something("Notes", "run")


def test_source_is_cut_from_the_text(spark):
    from strataloom.llm.documented import pairs

    f = spark.createDataFrame([("r", "b.js", "h")], "repo string, path string, hash string")
    s = spark.createDataFrame([("h", FILES["b.js"].replace("\n", "\r\n"))], "hash string, source string")
    c = spark.createDataFrame([(3, "r", "b.js", None, 4, "stale", None)], "unit_id long, repo string, path string, name string, start_line int, source string, signature string")
    got = pairs(f, s, c).collect()
    assert [(r.unit_id, r.source) for r in got] == [(3, "export function keep(a) {\n  a.forEach((x) => {\n    x.y();\n  });\n}")]
