import pytest

from strataloom.extract import parse
from strataloom.extract.code import MAX_DEPTH
from strataloom.extract.markup import MAX_BYTES, MAX_LINES
from strataloom.extract.tables import extracted

PYTHON = '''# About the module.

import os.path as p
from .a import x as y, z

LIMIT = 3


# Adds.
@wrap(1)
async def add(a, b=(1, 2)):
    """Sum of two."""
    return helper(a) + self.go(b)  # trailing


class Box(Base):
    def __init__(self):
        pass

    def size(self) -> int: return 1

class TestBox:
    def test_size(self):
        assert Box().size()
'''


def names(p):
    return [(d.kind, d.qualified("."), d.parent) for d in p.declarations]


def test_python():
    p = parse(PYTHON, "python")
    assert names(p) == [("constant", "LIMIT", None), ("function", "add", None), ("class", "Box", None), ("constructor", "Box.__init__", 2), ("method", "Box.size", 2), ("class", "TestBox", None), ("method", "TestBox.test_size", 5)]
    add = p.declarations[1]
    assert add.signature == "async def add(a, b=(1, 2))" and add.attributes == ["async"] and add.description == "Adds.\nSum of two."
    assert PYTHON[add.start : add.end].endswith("self.go(b)")
    assert [(i.path, i.name, i.alias) for i in p.imports] == [("os.path", None, "p"), (".a", "x", "y"), (".a", "z", None)]
    assert {(o, n, r) for _, o, n, r in p.calls} >= {(1, "helper", None), (1, "go", "self"), (6, "Box", None), (6, "size", "?")}
    assert p.description == "About the module." and len(p.tests) == 2 and not p.faults


CASES = {
    "javascript": ("/** Says. */\nexport async function say(a) { call(); }\nclass A { constructor() {} go(x) { return this.say(x); } }\nconst K = { a: 1 };\nconst f = (x) => { x(); };\ndescribe('a', () => { it('b', () => {}); });\n",
                   [("function", "say"), ("class", "A"), ("constructor", "A.constructor"), ("method", "A.go"), ("constant", "K"), ("function", "f")]),
    "java": ("package a;\nimport java.util.List;\npublic class A {\n  private int n = 1;\n  A() {}\n  @Test\n  public int go(int x) { if (x > 1) { return 1; } return n; }\n}\n", [("class", "A"), ("field", "A.n"), ("constructor", "A.A"), ("method", "A.go")]),
    "go": ("package a\n\nimport (\n\t\"fmt\"\n\tb \"c/d\"\n)\n\nconst N = 1\n\ntype T struct {\n\tn int\n}\n\nfunc (t *T) Go(x int) int {\n\treturn fmt.Sum(x)\n}\n", [("constant", "N"), ("struct", "T"), ("field", "T.n"), ("method", "T.Go")]),
    "rust": ("use a::{b, c as d};\nconst N: i64 = 1;\nimpl<T> Show for Box<T> {\n    pub fn go(&self) -> i64 { other(1) }\n}\n#[test]\nfn works() { go(); }\n", [("constant", "N"), ("impl", "Box"), ("method", "Box.go"), ("function", "works")]),
    "c": ("#include <stdio.h>\n#define N 1\n#define F(x) x\n/* Adds. */\nstatic int add(int a, int b) {\n  for (;;) { return sum(a, b); }\n}\n", [("constant", "N"), ("function", "add")]),
    "bash": ("#!/bin/sh\nN=1\ngo() {\n  M=2\n  echo hi\n}\nfunction run { go; }\n", [("constant", "N"), ("function", "go"), ("function", "run")]),
    "json": ('{"a": {"b": [1, {"c": 2}]}, "d": "x"}', [("item", "a"), ("item", "a.b"), ("item", "a.b.[1]"), ("item", "a.b.[1].c"), ("item", "d")]),
    "yaml": ("a:\n  b: 1\n  c: |\n    d: no\n  'e f': 2\nlist:\n- x: 1\n  y: 2\n", [("item", "a"), ("item", "a.b"), ("item", "a.c"), ("item", "a.e f"), ("item", "list"), ("item", "list.x"), ("item", "list.y")]),
    "toml": ("[a.b]\nc = 1\n[[d]]\n\"e\" = 2\n", [("table", "a.b"), ("item", "a.b.c"), ("table", "d"), ("item", "d.e")]),
    "css": (".a, .b > c { d: e }\n@media x { .f { g: h } }\n", [("rule", ".a, .b > c"), ("rule", "@media x"), ("rule", "@media x..f")]),
    "markdown": ("# A #\ntext\n```\n# no\n```\nB *b*\n===\n### C\n\n## \nx\n", [("heading", "A"), ("heading", "B *b*"), ("heading", "B *b*.C"), ("heading", "B *b*.<anonymous@10:1>")]),
}


@pytest.mark.parametrize("language", CASES)
def test_languages(language):
    text, want = CASES[language]
    p = parse(text, language)
    assert [(d.kind, d.qualified(".")) for d in p.declarations] == want and not p.faults


def test_details():
    p = parse(CASES["javascript"][0], "javascript")
    assert p.declarations[0].attributes == ["export", "async"] and p.declarations[0].description == "Says." and len(p.tests) >= 1
    p = parse(CASES["rust"][0], "rust")
    assert [(i.path, i.name, i.alias) for i in p.imports] == [("a", "b", None), ("a", "c", "d")] and len(p.tests) == 1
    assert [(i.path, i.alias) for i in parse(CASES["go"][0], "go").imports] == [("fmt", None), ("c/d", "b")]
    assert parse(CASES["c"][0], "c").declarations[1].description == "Adds."


def test_broken_texts():
    assert parse("", "python").declarations == [] and parse("x", None).declarations == [] and parse("x", "unknown").declarations == []
    p = parse("def a(:\n  x = (\n\nclass B:\n", "python")
    assert p.faults and any(d.name == "a" for d in p.declarations)
    assert any("Conflict" in m for _, m in parse("<<<<<<< a\nint f() { return 1; }\n=======\n>>>>>>> b\n", "c").faults)
    deep = parse("{" * (MAX_DEPTH + 900) + "}" * (MAX_DEPTH + 900), "javascript")
    assert any("deep" in m for _, m in deep.faults)
    for text in ("'", '"""', "/*", "`", "\\", "\x00", "é" * 10_000, "((((", "}}}}"):
        for language in (*CASES, "python"):
            parse(text, language)


def test_chunks():
    text = "# A\n" + "word\n" * 400 + "\n## B\n" + "é" * 20_000 + "\n"
    p = parse(text, "markdown")
    assert len(p.chunks) > 6
    for c in p.chunks:
        assert len(c.text.encode()) <= MAX_BYTES and c.text.count("\n") < MAX_LINES and c.text.startswith("# A")
    inside = "".join(text[c.start : c.end] for c in p.chunks)
    assert inside.count("word") == 400 and inside.count("é") == 20_000


def test_rows(spark):
    rows = [("1", "python", PYTHON, "x"), ("1", "python", PYTHON, "x"), ("2", None, "a", "x"), ("3", "python", None, "x"), ("4", "python", "", "x"), (None, "json", '{"é": 1}', "x")]
    df = spark.createDataFrame(rows, "hash string, language string, source string, kind string")
    got = extracted(df).collect()
    assert sum(r.what == "declaration" and r.key == "1" for r in got) == 14
    key = [r for r in got if r.key is None and r.what == "declaration"]
    assert [(r.name, r.start_byte, r.end_byte, r.start_line, r.end_column) for r in key] == [("é", 1, 8, 1, 9)]
    assert extracted(df.limit(0)).count() == 0


def test_uses(spark):
    from strataloom.operators.callgraph import resolved_references
    from strataloom.extract.tables import kind_of

    files = {"a.py": "from b import LIMIT as top, other\n\nSIZE = 3\n\ndef f(other):\n    x = SIZE + top\n    return other\n\ndef g():\n    SIZE = 1\n    return SIZE, f\n", "b.py": "LIMIT = 1\n\ndef other():\n    return LIMIT\n"}
    p = parse(files["a.py"], "python")
    assert {(o, n) for _, o, n in p.uses} == {(1, "SIZE"), (1, "top"), (2, "f")}
    t = spark.createDataFrame([("r", k, "python", v) for k, v in files.items()], "repo string, path string, language string, source string")
    rows = extracted(t, "path")
    of = lambda what: t.select("repo", "path", "language").join(kind_of(rows, what), t.path == rows.key).drop("key")
    got = resolved_references(of("declaration"), of("use"), of("import"))
    assert {(r.src_path, r.src_id, r.dst_path, r.dst_id) for r in got.collect()} == {("a.py", 2, "a.py", 1), ("a.py", 2, "b.py", 1), ("a.py", 3, "a.py", 2), ("b.py", 2, "b.py", 1)}
