import numpy as np
import pytest

from strataloom.llm.grammar import GRAMMARS, pairs
from strataloom.llm.syntax import LANGUAGES, ROLE, ROLES, _pairs, roles_of


def test_pairs_of_a_small_grammar():
    g = {"file": ["BOF item rest* end? EOF"], "item": ["NUM", "( item? )"], "rest": [", item"], "end": [";", "NL"]}
    got = pairs(g)
    both = {(a, b) for a, b, n in got if not n}
    assert both == {("BOF", "NUM"), ("BOF", "("), ("NUM", ","), (")", ","), ("(", "NUM"), ("(", "("), ("(", ")"), ("NUM", ")"), (")", ")"), (",", "NUM"), (",", "("), ("NUM", ";"), (")", ";"), (";", "EOF"), ("NUM", "EOF"), (")", "EOF")}
    assert {x[:2] for x in got if x[2]} == both  # what ends a line here ends the text too


def test_grammars_are_whole():
    assert set(GRAMMARS) == set(LANGUAGES)
    for lang, g in GRAMMARS.items():
        used = {s[:-1] if len(s) > 1 and s[-1] in "?*+" else s for ps in g.values() for p in ps for s in p.split()}
        assert used - set(g) <= set(ROLE) | {"NL"}, lang
        assert set(g) - used == {"file"}, lang


VALID = {
    "python": ["import os, sys as s\nfrom . import a as b\nfrom ..c import (d,\n e,)\nx: int = 3\ny = z = lambda q, *r, k=1, **kw: q[1:2, ::3]\n@dec(1)\nclass A(B, metaclass=C):\n    async def f(self, /, a: int = 1, *, b) -> list[int]:\n        async with a as b, c:\n            yield await x\n        return [i async for i in z if i if not i]\n\ntry:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    del a, b[0]\nfinally:\n    assert a, 'b'\nwhile a < b is not c:\n    if a: continue\n    elif b: break\n    else: print({**a, 'b': 1}, {*a}, f(*a, **b), a if b else c, not a, -1, ~1, ...)\nmatch x:\n    case [1, *r] if r: pass\n    case A(b=1) | None: pass\nglobal g\nx += 1; y @= 2\nfor a, (b, c) in d: nonlocal h\n"],
    "javascript": ["import a, { b as c, default as d } from 'x';\nimport * as e from \"y\";\nexport default function* g(a, { b = 1, ...c }, [d, , f] = [], ...r) { yield* a; }\nconst { x, y: { z } } = o, q = async (a) => { await a; };\nlet n\nvar t = `a`, u = /x/g, v = a ? b : c\nclass A extends B.C { #p = 1; static s = 2; constructor() { super(); } get x() { return this.#p; } async *m() {} static { f(); } [k]() {} }\nfor (const a of b) { continue; }\nfor (let i = 0, j; i < 3; i++) if (a) b(); else { c() }\nfor (k in o) ;\nwhile (a) { break }\ndo { x-- } while (y);\nswitch (a) { case 1: case 'b': f(); break; default: g() }\ntry { throw new E(1); } catch { } finally { }\nlabel: for (;;) { break label }\nx?.y?.[0]?.(1); a ??= b; f`t`; typeof a === 'b' || void 0 && !c in d instanceof E;\nexport { a as b }; export * from 'z';\n({ a, b: 1, [c]: 2, 'd': 3, e() {}, get f() { return 1 }, ...g, async h() {} });\nif (a) { } else if (b) { }\n(() => 1)();\nx = a, b\n[1, 2].map(f)\n"],
    "typescript": ["import type { A } from './a';\nexport interface B<T extends C = D> extends E<F>, G { readonly a?: string; b(x: number): void; [k: string]: any; new (x: T): B; }\nexport type U = 'a' | 1 | null | { a: string, b?: number[] } | ((x: T) => void) | [A, B?];\ntype M<T> = { [K in keyof T]?: T[K] };\nenum Color { Red = 1, Green, Blue = 'x' }\nabstract class P<T> implements Q, R<S> { private x: number = 1; constructor(private readonly a: A, public b?: B) { super(); } protected abstract f(): void; static g<T>(x: T): x is string { return x as any; } y!: string; }\nfunction h(this: Window, a: string, b?: number, ...c: any[]): asserts a is string { }\nconst x = <T,>(y: T): T => y;\nlet z = a! as unknown as B<C>;\ndeclare const w: number;\ndeclare module 'm' { export function f(): void; }\nnamespace N { export const a = 1 }\nexport default class {}\nconst q: Map<string, Array<number>> = new Map<string, number[]>();\nlet v: typeof x;\nfor (const [a, b] of c) { }\n@dec() class K { @Input() a: string; }\nconst s = { a } satisfies T;\nexport const e = async <T>(x: T): Promise<void> => { };\ntry { } catch (e: unknown) { }\n"],
    "java": ["package a.b;\nimport static a.B.*;\nimport c.D;\n@Anno(a = 1, b = {2, 3})\npublic final class A<T extends B & C> extends D<E> implements F, G<H[]> {\n  private static final int X = 1, Y[] = {1, 2};\n  Map<String, List<int[]>> m = new HashMap<>();\n  static { f(); }\n  public <R> R g(final int a, String... b) throws E, F { return (R) a; }\n  A() { this(1); }\n  enum K { P, Q(1) { void x() {} }, ; int z; }\n  interface I { int a(); default void b() {} }\n  void h() {\n    for (int i = 0, j = 1; i < 3; i++, j--) { continue; }\n    for (var x : xs) if (x instanceof String s) y(); else z();\n    int[][] q = new int[3][]; int w = a ? b : c;\n    try (var r = open(); s) { throw new E(); } catch (A | B e) { } finally { }\n    switch (a) { case 1: case 2: f(); break; default: g(); }\n    int v = switch (k) { case A, B -> 1; default -> { yield 2; } };\n    Runnable l = () -> { }; F f = (a, b) -> a + b; g(A::new, x -> x, B[].class, int.class);\n    label: while (true) { break label; }\n    synchronized (this) { assert a : b; }\n    do { a[0]++; } while (!b);\n    Object o = (String) p.q().<T>r(-1L);\n    List<? extends A> t = null; List<?> u;\n    new A() { void f() {} }.f();\n  }\n}\nrecord R(int a, String b) { }\nsealed interface S permits T { }\n"],
    "go": ["package a\n\nimport (\n\tx \"a\"\n\t. \"b\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n\tm map[string][]func(int) (a, b error)\n}\n\ntype I interface {\n\tF(a int, b ...string) error\n\t~int | string\n}\n\nconst (\n\tP = iota\n\tQ\n)\n\nvar y, z = 1, \"b\"\n\nfunc (t *T[K, V]) G(a, b int, c ...string) (r int, err error) {\n\tif v, ok := m[k]; ok && !v {\n\t\treturn\n\t} else if x := f(); x > 1 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tf()\n\tdefault:\n\t\tgoto end\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\tdefault:\n\t}\n\tgo func() { f() }()\n\tdefer g(a...)\n\ts := []int{1, 2, 3}[1:2]\n\tp := &T{A: 1, B: []string{\"a\"}}\n\tq := map[string]struct{}{}\n\tvar ch chan<- int = make(chan int, 1)\nend:\n\tx.y[0].z(*p, -1, ^2)\n\treturn 1, nil\n}\n"],
    "rust": ["#![allow(dead_code)]\nuse std::{io::{self, Read as R}, fmt::*};\nmod a;\npub(crate) const N: usize = 1;\nstatic mut S: &'static str = \"a\";\n#[derive(Debug, Clone)]\npub struct P<'a, T: A + 'a = B> where T: C<D = E> { pub x: &'a mut T, y: [u8; 4] }\nstruct U(pub i32, String);\nenum E { A, B(i32), C { x: u8 }, D = 3 }\nimpl<T> A for P<'_, T> where T: B { type X = Y; fn f(&mut self, (a, b): (i32, i32)) -> Result<(), Box<dyn E + Send>> { let x = a?; Ok(()) } }\ntrait T: A { const C: i32; fn g(self) -> impl F { } fn h(); }\nfn main() {\n  let mut v: Vec<Vec<u8>> = vec![1; 3];\n  if let Some(x) = y { } else if a && !b { } else { }\n  match x { 1 | 2 => a(), A::B { x, .. } if x > 1 => { b() } 'a'..='z' => (), _ => {} }\n  for (i, c) in s.iter().enumerate() { continue; }\n  'outer: loop { break 'outer; }\n  while let Some(_) = it.next() { }\n  let f = move |a: i32, b| -> i32 { a + b };\n  let g = |x| x * 2;\n  println!(\"{} {}\", a, b.c as f64);\n  assert_eq!(a, &b[1..], \"x\");\n  let P { x, y: z } = p; let s = S { a, ..Default::default() };\n  unsafe { *p = 1 };\n  x = <T as A>::f::<u8>(-1).await?;\n  let Some(q) = r else { return };\n  a[0] += 1; return (1, 2).0;\n}\n"],
    "c": ["#include <a.h>\n#define X(a) ((a) + 1)\ntypedef struct node { int a, *b; struct node *next; unsigned c : 3; } node_t;\nenum e { A = 1, B, };\nstatic const char *const names[] = { \"a\", [2] = \"b\" \"c\", };\nextern int f(const char *, int (*cb)(void *, int), ...);\nunion u { int i; float f; };\nint (*fp)(int) = 0, arr[3][4] = { { 1 }, };\nstatic inline unsigned long g(struct node *n, int k) {\n  int i = 0; struct node m = { .a = 1, .next = &m };\n  for (i = 0, k--; i < 3; ++i) { if (!n) continue; else break; }\n  do { n->a++; } while (0);\n  switch (k) { case A: case 'b': g(n, 1); break; default: ; }\n  goto end;\nend:\n  return (unsigned long) n->next[0].a ? sizeof(int) * ~k : -1;\n}\nvoid h(void) { while (1) ; x = y = (int *) p; }\n"],
    "bash": ["#!/bin/bash\nset -e\nA=1 B=\"$x\" cmd -a --b=c \"$@\" > out.txt 2>&1 < in | grep x && echo ok || exit 1\nf() {\n  local a=$1\n  if [ -z \"$a\" ]; then return 1; elif [[ $a == b* ]]; then :; else echo no; fi\n}\nfunction g { for i in 1 2 \"$x\"; do echo $i; done; }\nwhile read -r l; do\n  case \"$l\" in\n    a|b) echo 1 ;;\n    *) echo 2\n      ;;\n  esac\ndone < file\n( cd x && ls ) &\nx=$(date +%s); y=$((1 + 2))\n! true\narr=(a b c)\nuntil false; do break; done\n{ echo a; echo b; } >&2\ncat <<EOF\nif x\nEOF\n"],
    "json": ['{"a": [1, -2.5e3, true, null, {}], "b": {"c": "d"}, "e": []}', "[]", '"x"'],
    "yaml": ["a: 1\nb:\n  - c: d\n    e: [f, g]\n  - h\nk: |\n  text\n---\nl: {m: n}\n"],
    "css": ["@import url(x.css);\n:root { --a: 1px; }\na:hover > .b, #c ~ d[e=\"f\"]::after { color: #fff; margin: -1px auto !important; background: url(x.png) no-repeat }\n@media (max-width: 10px) and (min-width: 2px) { .x { width: calc(100% - 2px); } }\n@keyframes k { from { top: 0 } 50% { top: 1px } }\n"],
}

ALLOWED = {(lang, a, b, n) for lang, a, b, n in _pairs()}


@pytest.mark.parametrize("language", VALID)
def test_valid_texts_have_only_permissible_pairs(language):
    r, _, line, n = roles_of(VALID[language], language)
    first = np.cumsum(n) - n
    for k in range(len(n)):
        a, at = r[first[k] : first[k] + n[k]].tolist(), line[first[k] : first[k] + n[k]].tolist()
        wrong = [(ROLES[x], ROLES[y], at[i + 1]) for i, (x, y) in enumerate(zip(a, a[1:], strict=False)) if (language, x, y, at[i] < at[i + 1]) not in ALLOWED]
        assert not wrong


BROKEN = {"python": "def f(:\n    pass\n", "javascript": "const a = ;\n", "typescript": "let x: = 1;\n", "java": "class A { int x = ; }\n", "go": "package a\n\nfunc () {\n}\nvar x = = 1\n", "rust": "fn f( -> i32 { 1 }\n", "c": "int x = ;\n", "bash": "if ; then echo; fi\n", "json": '{"a" 1}'}


@pytest.mark.parametrize("language", BROKEN)
def test_broken_texts_have_others(language):
    r, _, line, n = roles_of([BROKEN[language]], language)
    assert any((language, x, y, i < j) not in ALLOWED for x, y, i, j in zip(r[:-1].tolist(), r[1:].tolist(), line[:-1].tolist(), line[1:].tolist(), strict=True))
