import pytest

from strataloom.llm.syntax import invalid_files, invalid_texts

GOOD = {
    "python": ["", "# c\n", "def f(a, *, b=1) -> int:\n    'd'\n    return a if b else {1: [2]}\n", "x = '''\n<<<<<<< HEAD\n'''\n", "class A:\n    @p\n    async def f(self):\n        await x\n", "match x:\n    case 1: pass\nprint('a' 'b')\n", "﻿x = 1\r\ny = 2\r\n"],
    "javascript": ["import { a } from \"./b\";\nexport async function f(a, b) {\n  for (const x of a) { if (/[/\"]/.test(x)) return `q${x}`; }\n}\nconst o = { class: 1, get x() { return 1 }, ...b };\nlet y = a ? b : c\nfoo()\n", "!function(e,t){\"use strict\";var n=1;e.f=function(w){return w|n}}();", "const s = `\n<<<<<<< HEAD\n`;\n"],
    "typescript": ["export class A<T> {\n  private readonly x: number = 1;\n  f(a: string[], b?: Map<string, Array<number>>): void { this.x!; }\n}\ninterface B { a: string }\ntype C = keyof B;\ndeclare const z: number;\n"],
    "java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B> {\n  private static final int[] X = {1, 2};\n  @Override public List<T> f(int a, String... b) throws E { for (int i = 0; i < 3; i++) { x += (int) y; } return new A<>(); }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\tcount int `json:\"c\"`\n}\n\nfunc (t *T) F(a []int) (int, error) {\n\tout := map[int]int{}\n\tfor i, x := range a {\n\t\tout[x] = i\n\t}\n\tif len(a) == 0 {\n\t\tpanic(\"x\")\n\t} else {\n\t\treturn 0, nil\n\t}\n\treturn len(out), nil\n}\n", "/*\n<<<<<<< HEAD\n*/\npackage b\n"],
    "rust": ["use crate::a::B;\n\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\n\nimpl<'a> S<'a> {\n    fn f(&self, v: &[i64]) -> i64 {\n        let mut t = 0;\n        for x in v.iter() { if x.a > 1 { t += x.a; } }\n        v.iter().filter(|i| i.x > 1).map(|i| i.x).sum()\n    }\n}\n"],
    "c": ["#include <stdio.h>\n#define A(x) \\\n  ((x) + 1)\nstatic const char *s[] = {\"a\" \"b\", \"c\"};\nint f(struct e *p, int n) {\n    for (int i = 0; i < n; i++) { p->x += a[i]; }\n    return p ? 1 : 0;\n}\n"],
    "bash": ["#!/bin/sh\nf() {\n  local a=1\n  for x in \"$@\"; do\n    if [ -f \"$x\" ]; then\n      a=$((a + 1))\n    fi\n  done < \"$1\"\n  echo \"no fi here\" >&2\n}\ncase $1 in\n  a) f ;;\nesac\n", "cat <<'T'\n<<<<<<< HEAD\nif\nT\n"],
    "json": ['{"a": [1, -2.5e3, null], "b": {"c": "\\u00e9"}}\n', "[]", "3"],
    "yaml": ["a: 1\nb:\n  c: [1,\n    2]\n  d: \"x: y\"\nl:\n- 1\n- e: 2\n  f: |\n    any: : thing\n   \ng: text\n  goes on\n", "--- \n- a\n- b: {c: d}\n", "# only\n", '{"a": 1}\n'],
    "css": [".a-b {\n  width: 4px;\n}\n@media (min-width: 3px) { a:hover > b { color: #fff } }\n", ".c0{margin:2px;order:1}"],
}
BAD = {
    "python": ["def f(a\n", "def f( (a, b)\n    return 1\n", "x = 1\n<<<<<<< HEAD\ny = 2\n=======\n>>>>>>> b\n", "def f():\n", "for index, value\n", "function f() { return 1; }\n", "x = 'abc\n", "def par", "if x:\npass\n", "try:\n    x\ny = 1\n"],
    "javascript": ["function f(a {\n}\n", "const x: number = 1;\n", "def f(x):\n    return x\n", "const a = ", "f(( a);", "<<<<<<< main\nlet a = 1;\n=======\n>>>>>>> b\n", "let s = \"abc\n", "package a\n\nfunc F() int {\n}\n"],
    "typescript": ["export class A {\n  f(a: number {\n  }\n}\n", "export", "function f(\n"],
    "java": ["public class A {\n  int f() { return 1; }\n", "class A { int f() { return 1 } }\n", "package a.b\nclass A {}\n", "import { a } from \"b\";\n"],
    "go": ["package a\n\nfunc F", "package a\n\nfunc F() {\n", "package a\nconst X\n", "public class A { }\n", "package a\n\nfunc F(a int, ) ) int {\n}\n"],
    "rust": ["fn f() -> i64 {\n    let x = 1\n}\n", "fn f(", "const X: i64 =", "def f(x):\n    return x\n"],
    "c": ["int f(int a) {\n    return a }\n", "int f(int a) {\n", "use crate::a::B;\n", "import { a } from \"./b\";\nlet x = 1;\n"],
    "bash": ["if [ -f x ]; then\n  echo a\n", "f() {\n  echo a\n", "for x in a; do\n  echo \"a\n", "<<<<<<< main\na=1\n=======\n>>>>>>> b\n"],
    "json": ["{'a': 1}", '{"a": 1,}', "a: 1\n", '{"a": [1}', "", '{"a": NaN}', '{"a" 1}'],
    "yaml": ["a: 1\n<<<<<<< HEAD\nb: 2\n=======\n>>>>>>> x\n", "a: [1, 2\nb: 3\n", "a: 1\n   b: 2\n", "a: \"x\nb: 1\n", "from .a import b\n\ndef f(x):\n  return 1\n", "a: b: c\n"],
    "css": [".a { width: 1px;\n", ".a { width 1px; }\n", "import { a } from \"b\";\nconst x = 1;\n", ".a"],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{kind}:{lang}:{i}", lang, t) for kind, all_ in (("good", GOOD), ("bad", BAD)) for lang, texts in all_.items() for i, t in enumerate(texts)]
    rows += [("none", "python", None), ("md", "markdown", "<<<<<<< HEAD\n"), ("long", "c", "int a;\n" * 60_000)]
    return {r.id: r for r in invalid_texts(spark.createDataFrame(rows, "id string, language string, source string")).collect()}


def test_valid_texts(found):
    assert not {k: (v.line, v.message) for k, v in found.items() if not k.startswith("bad")}


def test_invalid_texts(found):
    want = {f"bad:{lang}:{i}" for lang, texts in BAD.items() for i in range(len(texts))}
    assert want - set(found) == set()


def test_files(spark, found):
    f = spark.createDataFrame([("r", "a.py", "h", "python"), ("r", "b.json", "h", "json"), ("r", "c", "h", "python"), ("r", "d.md", "h", None), ("r", "e.py", "gone", "python"), ("r", "g.py", None, None), (None, None, "h", None)], "repo string, path string, hash string, language string")
    s = spark.createDataFrame([("h", "def f(:\n", 1), ("i", None, 1)], "hash string, source string, line int")
    got = {(r.path, r.syntax) for r in invalid_files(f, s).collect()}
    assert got == {("a.py", "python"), ("b.json", "json"), ("c", "python")}
    assert invalid_files(f.limit(0), s.limit(0)).count() == 0
