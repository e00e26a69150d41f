"""Declarations of source code, from tokens and the nesting of blocks.

A text is walked once. A statement's header, up to the block or the end that follows it,
tells what it declares; the block is walked for members where its kind can have any. Broken
texts give what can be told, and a message for what cannot.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

import numpy as np

from strataloom.extract.lex import CLASSES, KEYWORD0, KEYWORDS, lex

MAX_DEPTH = 512  # blocks within blocks that are walked
MAX_SECONDS = 10.0  # for one text
CALLABLE = {"function", "method", "constructor", "generator"}
# Words that stand before a declaration.
MODIFIERS = set("export default public private protected static final abstract async pub unsafe extern const inline readonly override declare sealed synchronized native volatile transient virtual".split())
# Keyword of a container and the kind of its declaration.
_CONTAINERS = {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "union": "union", "trait": "trait", "impl": "impl", "mod": "module", "namespace": "namespace", "record": "class"}
_CONTROL = set("if for while switch catch return new throw else do try case match loop sizeof typeof await yield delete go defer select assert synchronized with".split())
_FUNCTION = {"function", "func", "fn"}


@dataclass
class Declaration:
    kind: str
    name: str
    start: int  # characters
    end: int
    parent: int | None = None
    scope: list[str] = field(default_factory=list)
    signature: str | None = None
    attributes: list[str] = field(default_factory=list)
    body: int | None = None  # where the body begins
    level: int | None = None
    description: str | None = None

    def qualified(self, joint: str) -> str:
        return joint.join([*self.scope, self.name])


@dataclass
class Import:
    path: str
    name: str | None
    alias: str | None = None
    wildcard: bool = False


class Tokens:
    """The tokens of a text without its comments, and the comments."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        cls, start, end = lex(text, language)
        words = dict(enumerate(KEYWORDS.get(language, "").split(), KEYWORD0))
        names = [words[c] if c >= KEYWORD0 else CLASSES[c] for c in cls]
        self.comments = [(a, b) for n, a, b in zip(names, start, end, strict=True) if n == "COMMENT"]
        self.tags = [(a, b) for n, a, b in zip(names, start, end, strict=True) if n == "TAG"]
        keep = [i for i, n in enumerate(names) if n not in ("COMMENT", "TAG")]
        self.name, self.start, self.end = ([v[i] for i in keep] for v in (names, start, end))
        self.word = [text[a:b] for a, b in zip(self.start, self.end, strict=True)]
        self.mate: dict[int, int] = {}
        self.faults: list[tuple[int, str]] = []
        open_: list[int] = []
        pair = {")": "(", "]": "[", "}": "{"}
        for i, n in enumerate(self.name):
            if n in ("(", "[", "{"):
                open_.append(i)
            elif n in pair:
                if open_ and self.name[open_[-1]] == pair[n]:
                    self.mate[open_.pop()] = i
                elif language != "bash" or n != ")":
                    self.faults.append((self.start[i], f"Unexpected {n}"))
            elif n == "OPEN":
                self.faults.append((self.start[i], "String or comment has no end"))
            elif n == "MARK":
                self.faults.append((self.start[i], "Conflict marker"))
            elif n == "CHAR":
                self.faults.append((self.start[i], f"Unexpected {self.word[i]}"))
            elif n == "BADINDENT":
                self.faults.append((self.start[i], "Indentation matches no block"))
        self.faults += [(self.start[i], f"Missing end of {self.name[i]}") for i in open_ if language != "bash"]

    def __len__(self) -> int:
        return len(self.name)

    def ident(self, i: int) -> bool:
        return 0 <= i < len(self) and (self.name[i] == "IDENT" or re.fullmatch(r"[^\W\d][\w$]*", self.word[i]) is not None and self.name[i] not in _CONTROL)


class _Stop(Exception):
    pass


class Walk:
    """One pass over a text in a language with blocks in braces."""

    def __init__(self, t: Tokens):
        self.t, self.out, self.until = t, [], time.monotonic() + MAX_SECONDS

    def close(self, i: int) -> int:
        """The bracket that ends the one at ``i``, or the last token."""
        return self.t.mate.get(i, len(self.t) - 1)

    def block(self, i: int, end: int, parent: int | None, scope: list[str], within: str, depth: int = 0) -> None:
        t, lang = self.t, self.t.language
        if depth > MAX_DEPTH or time.monotonic() > self.until:
            raise _Stop
        while i < end:
            n = t.name[i]
            if n in (";", "}", ")", "]", ",", "NEWLINE"):
                i += 1
                continue
            first = i
            # the header runs to a block, the end of the statement or an assignment
            j, names = i, []
            while j < end and t.name[j] not in ("{", ";", "=", "}", "NEWLINE"):
                if t.name[j] in ("(", "["):
                    names.append((j - 1, j))
                    j = self.close(j)
                elif t.name[j] == ":" and t.name[first] in ("case", "default"):
                    break
                j += 1
            stop = t.name[j] if j < end else "EOF"
            i = self.statement(first, j, stop, end, names, parent, scope, within, depth)

    def statement(self, first: int, j: int, stop: str, end: int, names: list, parent: int | None, scope: list[str], within: str, depth: int) -> int:
        t, lang = self.t, self.t.language
        at = first
        while at < j and (t.word[at] in ("@", "#") or t.name[at] == "@"):  # annotations and attributes
            at += 1
            if at < j and t.name[at] == "[":
                at = self.close(at) + 1
            elif at < j:
                at += 1
                while at + 1 < j and t.name[at] == ".":
                    at += 2
                if at < j and t.name[at] == "(":
                    at = self.close(at) + 1
        begin, mods = at, []
        while at < j and (t.word[at] in MODIFIERS) and not (t.word[at] == "const" and lang not in ("rust", "c")):
            if t.word[at] == "const" and lang == "rust" and at + 1 < j and t.name[at + 1] not in ("fn", "unsafe"):
                break
            mods.append(t.word[at])
            at += 1
            if t.word[at - 1] == "pub" and at < j and t.name[at] == "(":
                at = self.close(at) + 1
        if begin >= j:
            return self.after(j, stop, end, parent, scope, within, depth, walk=True)
        head = t.word[at] if at < j else ""
        # containers
        if head in _CONTAINERS and stop == "{" and (t.name[at] != "IDENT" or t.ident(at + 1)):
            kind, name = _CONTAINERS[head], None
            if head == "impl":
                name = self.implemented(at + 1, j)
            elif t.ident(at + 1):
                name = t.word[at + 1]
            if name:
                return self.container(kind, name, begin, j, mods, parent, scope, depth)
        if head == "type" and lang == "go" and stop == "{" and t.ident(at + 1):
            kind = "interface" if t.word[j - 1] == "interface" else "struct"
            return self.container(kind, t.word[at + 1], begin, j, mods, parent, scope, depth)
        # functions
        fn = next((k for k in range(at, min(j, at + 4)) if t.name[k] in _FUNCTION or t.word[k] in _FUNCTION), None)
        if fn is not None and fn == at and stop in ("{", ";", "NEWLINE", "EOF"):
            k, owner = fn + 1, None
            if lang == "go" and k < j and t.name[k] == "(":
                inside = [w for w, n in zip(t.word[k + 1 : self.close(k)], t.name[k + 1 : self.close(k)], strict=True) if n == "IDENT"]
                owner = inside[1] if len(inside) > 1 else inside[0] if inside else None
                k = self.close(k) + 1
            star = k < j and t.word[k] == "*"
            k += star
            if t.ident(k):
                kind = "method" if owner or within in ("impl", "trait", "class", "interface") else "generator" if star else "function"
                up, sc = parent, scope
                if owner:
                    up = next((i for i, d in enumerate(self.out) if d.name == owner and d.kind in ("struct", "interface")), None)
                    sc = [owner]
                return self.callable(kind, t.word[k], begin, j, stop, end, mods, up, sc, depth)
        if head in ("const", "let", "var", "static") and lang in ("javascript", "typescript", "go", "rust", "jsx", "tsx"):
            k = at + 1 + (t.word[at + 1 : at + 2] == ["mut"])
            if lang == "go" and k < j and t.name[k] == "(":
                inner = self.close(k)
                for m in range(k + 1, inner):
                    if t.ident(m) and t.name[m - 1] in ("(", ";"):
                        last = next((x for x in range(m, inner) if t.name[x] == ";"), inner) - 1
                        self.add(Declaration("constant", t.word[m], t.start[m], t.end[last], parent, scope, None, []))
                return inner + 1
            if t.ident(k):
                e = self.value_end(j, stop, end)
                arrow = stop == "=" and any(t.name[x] == "=>" or t.name[x] in _FUNCTION for x in range(j, min(e + 1, len(t))) if self.outer(j, x))
                top = within in ("", "module", "namespace", "impl", "trait", "class")
                if arrow and top:
                    self.add(Declaration("function", t.word[k], t.start[begin], t.end[e], parent, scope, self.text(begin, j), mods, t.start[j]))
                elif top and (head != "let" or within == ""):
                    self.add(Declaration("constant", t.word[k], t.start[begin], t.end[e], parent, scope, None, mods))
                return e + 1
        # a name before parentheses and a block: functions of C and Java, methods of classes
        if names and stop in ("{", ";") and t.name[at] not in _CONTROL and fn is None:
            k, p = names[0]
            typed = k > at
            ok = stop == "{" and (within in ("class", "interface", "enum", "struct") or (lang in ("c", "java") and typed)) or (stop == ";" and within in ("class", "interface") and lang in ("java", "typescript") and typed and lang == "java")
            if ok and t.ident(k):
                name = t.word[k]
                kind = "constructor" if name == "constructor" or (lang == "java" and scope and name == scope[-1] and not typed) else "method" if within else "function"
                return self.callable(kind, name, begin, j, stop, end, mods, parent, scope, depth)
        if within in ("class", "struct", "interface") and stop in (";", "=", "NEWLINE", "EOF", "}") and not names:
            k = at if lang == "go" else j - 1
            while lang in ("typescript", "rust") and k > at and any(t.name[x] == ":" for x in range(at, k)):
                k -= 1
                if t.name[k] != ":" and t.ident(k) and t.name[k + 1] in (":", "?"):
                    break
            if t.ident(k) and (k > at or lang != "java"):
                e = self.value_end(j, stop, end)
                self.add(Declaration("field", t.word[k], t.start[begin], t.end[e], parent, scope, None, mods))
                return e + 1
        return self.after(j, stop, end, parent, scope, within, depth, walk=stop == "{" and depth < MAX_DEPTH)

    def outer(self, a: int, x: int) -> bool:
        """Whether ``x`` lies in no bracket that opens from ``a`` on."""
        return all(not (o < x < c) for o, c in ((o, c) for o, c in self.t.mate.items() if a <= o < x))

    def implemented(self, i: int, j: int) -> str | None:
        """The type of an impl header, without generics and trait."""
        t, depth, name = self.t, 0, None
        for k in range(i, j):
            depth += (t.name[k] == "<") - (t.name[k] == ">")
            if depth == 0 and t.word[k] == "for":
                name = None
            elif depth == 0 and t.word[k] == "where":
                break
            elif depth == 0 and t.name[k] == "IDENT":
                name = t.word[k]
        return name

    def value_end(self, j: int, stop: str, end: int) -> int:
        """The last token of a statement whose header ends at ``j``."""
        t = self.t
        if stop in (";", "NEWLINE"):
            return j if stop == ";" and t.end[j] > t.start[j] else j - 1
        if stop in ("EOF", "}"):
            return min(j, end, len(t)) - 1
        k, line = j + 1, None
        while k < end and t.name[k] not in (";", "NEWLINE"):
            if t.name[k] in ("(", "[", "{"):
                k = self.close(k)
            elif t.name[k] == "}":
                return k - 1
            k += 1
        if k >= end:
            return end - 1
        return k if t.name[k] == ";" and t.end[k] > t.start[k] else k - 1

    def text(self, a: int, j: int) -> str:
        """A header on one line."""
        return re.sub(r"\s+", " ", self.t.text[self.t.start[a] : self.t.end[j - 1]]).strip()

    def add(self, d: Declaration) -> int:
        self.out.append(d)
        return len(self.out) - 1

    def container(self, kind: str, name: str, begin: int, j: int, mods: list[str], parent: int | None, scope: list[str], depth: int) -> int:
        t, c = self.t, self.close(j)
        me = self.add(Declaration(kind, name, t.start[begin], t.end[c], parent, scope, self.text(begin, j), mods, t.start[j]))
        self.block(j + 1, c, me, [*scope, name], kind, depth + 1)
        return c + 1

    def callable(self, kind: str, name: str, begin: int, j: int, stop: str, end: int, mods: list[str], parent: int | None, scope: list[str], depth: int) -> int:
        t = self.t
        if stop != "{":
            e = self.value_end(j, stop, end)
            self.add(Declaration(kind, name, t.start[begin], t.end[e], parent, scope, self.text(begin, j), mods))
            return e + 1
        c = self.close(j)
        me = self.add(Declaration(kind, name, t.start[begin], t.end[c], parent, scope, self.text(begin, j), mods, t.start[j]))
        self.block(j + 1, c, me, [*scope, name], "callable", depth + 1)
        return c + 1

    def after(self, j: int, stop: str, end: int, parent: int | None, scope: list[str], within: str, depth: int, walk: bool) -> int:
        """Skip a statement that declares nothing itself; its block may hold declarations."""
        if stop == "{":
            c = self.close(j)
            if walk:
                self.block(j + 1, c, parent, scope, within if within == "" else "callable", depth + 1)
            return c + 1
        if stop == "=":
            return max(j + 1, self.value_end(j, stop, end) + 1)
        return j + 1


def _python(t: Tokens, until: float) -> list[Declaration]:
    """Declarations by indentation."""
    out: list[Declaration] = []
    open_: list[tuple[int, int]] = []  # (declaration, depth of its block)
    depth, n, i = 0, len(t), 0
    fresh, decorated = True, None
    while i < n:
        name = t.name[i]
        if name == "INDENT":
            depth += 1
        elif name == "DEDENT":
            depth -= 1
            while open_ and open_[-1][1] > depth:
                open_.pop()
        elif name == "NEWLINE":
            fresh = True
        elif fresh:
            fresh = False
            if depth > MAX_DEPTH or time.monotonic() > until:
                raise _Stop
            k = i
            if name == "@":
                decorated = i if decorated is None else decorated
                i += 1
                continue
            if t.name[k] == "async":
                k += 1
            parent = open_[-1][0] if open_ else None
            scope = [*out[parent].scope, out[parent].name] if parent is not None else []
            if k < n and t.name[k] in ("def", "class") and t.ident(k + 1):
                colon = k + 2
                while colon < n and t.name[colon] not in (":", "NEWLINE"):
                    colon = t.mate.get(colon, colon) + 1
                last = _suite_end(t, min(colon, n - 1))
                inner = parent is not None and out[parent].kind == "class"
                kind = "class" if t.name[k] == "class" else "function"
                if kind == "function" and inner:
                    kind = "constructor" if t.word[k + 1] in ("__init__", "__new__") else "method"
                signature = re.sub(r"\s+", " ", t.text[t.start[i] : t.end[colon - 1]]).strip()
                d = Declaration(kind, t.word[k + 1], t.start[i], t.end[last], parent, scope, signature, ["async"] if k > i else [], t.end[min(colon, n - 1)])
                d.description = _docstring(t, colon)
                out.append(d)
                open_.append((len(out) - 1, depth + 1))
            elif parent is None and depth == 0 and t.ident(i) and i + 1 < n and t.name[i + 1] in ("=", ":"):
                last = next((x for x in range(i, n) if t.name[x] == "NEWLINE"), n) - 1
                if any(t.name[x] == "=" for x in range(i, last + 1)):
                    out.append(Declaration("constant", t.word[i], t.start[i], t.end[last], None, [], None, []))
            decorated = None
        i += 1
    return out


def _suite_end(t: Tokens, colon: int) -> int:
    """The last token of the block after a colon."""
    i, n = colon + 1, len(t)
    if i < n and t.name[i] != "NEWLINE":
        return next((x for x in range(i, n) if t.name[x] == "NEWLINE"), n) - 1
    depth, last = 0, colon
    while i < n:
        if t.name[i] == "INDENT":
            depth += 1
        elif t.name[i] == "DEDENT":
            depth -= 1
            if depth <= 0:
                break
        elif t.name[i] != "NEWLINE":
            if depth == 0:
                break
            last = i
        i += 1
    return last


def _docstring(t: Tokens, colon: int) -> str | None:
    i = colon + 1
    while i < len(t) and t.name[i] in ("NEWLINE", "INDENT"):
        i += 1
    if i < len(t) and t.name[i] == "STR" and i > colon + 1:
        m = re.fullmatch(r"(?is)[rbu]*(\"\"\"|'''|\"|')(.*?)\1", t.word[i])
        return m[2] if m else None
    return None


def _bash(t: Tokens) -> list[Declaration]:
    out: list[Declaration] = []
    for i in range(len(t)):
        fresh = i == 0 or t.name[i - 1] in ("NEWLINE", ";", "}")
        if not fresh:
            continue
        m = re.match(r"([A-Za-z_]\w*)=", t.word[i])
        nest = any(o < i < c for o, c in t.mate.items() if t.name[o] == "{")
        if m and not nest:
            last = i
            while last + 1 < len(t) and t.start[last + 1] == t.end[last] and t.name[last + 1] not in ("NEWLINE", ";"):
                last += 1
            out.append(Declaration("constant", m[1], t.start[i], t.end[last], None, [], None, []))
            continue
        k = i + (t.word[i] == "function")
        if k < len(t) and re.fullmatch(r"[\w:-]+", t.word[k]):
            body = k + 1
            if body + 1 < len(t) and t.name[body] == "(" and t.name[body + 1] == ")":
                body += 2
            elif k == i:
                continue
            while body < len(t) and t.name[body] == "NEWLINE":
                body += 1
            if body < len(t) and t.name[body] == "{":
                c = t.mate.get(body, len(t) - 1)
                out.append(Declaration("function", t.word[k], t.start[i], t.end[c], None, [], t.text[t.start[i] : t.end[body - 1]].strip(), [], t.start[body]))
    return out


def declarations(t: Tokens) -> list[Declaration]:
    """All declarations of a text, in source order."""
    until = time.monotonic() + MAX_SECONDS
    try:
        if t.language == "python":
            out = _python(t, until)
        elif t.language == "bash":
            out = _bash(t)
        else:
            w = Walk(t)
            out = w.out
            w.block(0, len(t), None, [], "")
    except (_Stop, RecursionError):
        t.faults.append((0, "Text is nested too deeply or takes too long"))
    if t.language == "c":
        for a, b in t.tags:
            m = re.match(r"[ \t]*#[ \t]*define[ \t]+(\w+)(?![\w(])", t.text[a:b])
            if m:
                lead = len(t.text[a:b]) - len(t.text[a:b].lstrip())
                out.append(Declaration("constant", m[1], a + lead, b, None, [], None, []))
    order = sorted(range(len(out)), key=lambda i: (out[i].start, -out[i].end))
    place = {o: i for i, o in enumerate(order)}
    for d in out:
        d.parent = place.get(d.parent) if d.parent is not None else None
    return [out[i] for i in order]


def imports(t: Tokens) -> list[Import]:
    """Bindings that a text imports."""
    text, lang = t.text, t.language
    bare = list(text)
    for a, b in t.comments:
        bare[a:b] = re.sub(r"[^\n]", " ", text[a:b])
    text = "".join(bare)
    out: list[Import] = []
    if lang == "python":
        for m in re.finditer(r"(?m)^[ \t]*(?:from[ \t]+(\.*[\w.]*)[ \t]+)?import[ \t]+(\([^)]*\)|[^\n;#]+)", text):
            for part in m[2].strip("() \t\r").replace("\n", " ").split(","):
                w = part.split()
                if w:
                    alias = w[2] if len(w) == 3 and w[1] == "as" else None
                    out.append(Import(m[1] or w[0], w[0] if m[1] else None, alias, w[0] == "*"))
    elif lang in ("javascript", "typescript", "jsx", "tsx"):
        for m in re.finditer(r"(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?(?:([\w$*{},\s]+?)\s+from\s+)?[\"']([^\"'\n]+)[\"']", text):
            what = m[1] or ""
            for x in re.findall(r"\{([^}]*)\}", what):
                for part in filter(None, (p.strip() for p in x.split(","))):
                    w = part.split()
                    out.append(Import(m[2], w[0], w[2] if len(w) == 3 else None))
            rest = re.sub(r"\{[^}]*\}", "", what)
            for part in filter(None, (p.strip() for p in rest.split(","))):
                w = part.split()
                out.append(Import(m[2], "*", w[2], True) if w[0] == "*" and len(w) == 3 else Import(m[2], "default", w[0]))
            if not what:
                out.append(Import(m[2], None))
        for m in re.finditer(r"(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*[\"']([^\"'\n]+)[\"']\s*\)", text):
            if m[1]:
                out.append(Import(m[3], "*", m[1], True))
            for part in filter(None, (p.strip() for p in (m[2] or "").split(","))):
                w = re.split(r"\s*:\s*", part)
                out.append(Import(m[3], w[0], w[1] if len(w) > 1 else None))
    elif lang == "go":
        for m in re.finditer(r"(?m)^import\s*(\([^)]*\)|[^\n]+)", text):
            for alias, path in re.findall(r"([\w.]+\s+)?\"([^\"\n]+)\"", m[1]):
                out.append(Import(path, None, alias.strip() or None, alias.strip() == "."))
    elif lang == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text):
            out += [Import(p, n, a, n == "*") for p, n, a in _use_tree(re.sub(r"\s+", " ", m[1]).strip(), [])]
    elif lang == "java":
        for m in re.finditer(r"(?m)^[ \t]*import\s+(static\s+)?([\w.]+?)\.(\w+|\*)\s*;", text):
            out.append(Import(f"{m[2]}.{m[3]}" if not m[1] and m[3] != "*" else m[2], m[3], None, m[3] == "*"))
    elif lang == "c":
        for a, b in t.tags:
            m = re.match(r"[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text[a:b])
            if m:
                out.append(Import(m[1], None))
    return out


def _use_tree(tree: str, path: list[str]) -> list[tuple[str, str, str | None]]:
    """(path, name, alias) of each leaf of a use tree."""
    if m := re.fullmatch(r"(?:(.*?)::)?\s*\{(.*)\}", tree):
        inner, parts, depth, last = m[2], [], 0, 0
        for i, ch in enumerate(inner):
            depth += (ch == "{") - (ch == "}")
            if ch == "," and depth == 0:
                parts.append(inner[last:i])
                last = i + 1
        parts.append(inner[last:])
        return [leaf for p in parts if p.strip() for leaf in _use_tree(p.strip(), [*path, *(m[1].split("::") if m[1] else [])])]
    name, _, alias = tree.partition(" as ")
    whole = [*path, *name.strip().split("::")]
    if whole[-1] == "self" and len(whole) > 1:
        whole = whole[:-1]
    return [("::".join(whole[:-1]), whole[-1], alias.strip() or None)]


def calls(t: Tokens) -> list[tuple[int, str, str | None]]:
    """(place, name, receiver) of names that are called."""
    out = []
    for i in range(len(t) - 1):
        if t.name[i] == "IDENT" and t.name[i + 1] == "(" and t.start[i + 1] == t.end[i]:
            before = t.name[i - 1] if i else ""
            if before in _FUNCTION or before in ("def", "class"):
                continue
            receiver = None
            if before in (".", "::", "->"):
                receiver = t.word[i - 2] if i > 1 and re.fullmatch(r"[\w$]+", t.word[i - 2]) else "?"
            out.append((t.start[i], t.word[i], receiver))
    return out


def uses(t: Tokens, decls: list[Declaration], bound: list[Import]) -> list[tuple[int, int | None, str]]:
    """(place, innermost declaration, name) of uses of what the text declares at its top or imports, other than calls and members.

    A name that the enclosing callable takes as a parameter or assigns itself means that, and is no use.
    """
    known = {d.name for d in decls if d.parent is None} | {i.alias or (i.name if i.name not in (None, "*", "default") else i.path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].rsplit("::", 1)[-1]) for i in bound}
    spans = sorted((d.start, d.end, i) for i, d in enumerate(decls))
    own: dict[int, set[str]] = {}
    out: list[tuple[int, int | None, str]] = []
    found: list[tuple[int, int | None, str]] = []
    imported = 0  # up to here lies an import
    for i in range(len(t)):
        if i >= imported and t.name[i] in ("import", "from", "use", "package") and (i == 0 or t.name[i - 1] in ("NEWLINE", ";", "}", "INDENT", "DEDENT", "STR")):
            imported = i + 1
            while imported < len(t) and t.name[imported] not in ("NEWLINE", ";", "STR"):
                imported = t.mate.get(imported, imported) + 1
        if i < imported or t.name[i] != "IDENT" or t.word[i] not in known:
            continue
        before, after = t.name[i - 1] if i else "BOF", t.name[i + 1] if i + 1 < len(t) else "EOF"
        place = t.start[i]
        inside = [(e - s, k) for s, e, k in spans if s <= place < e]
        owner = min(inside)[1] if inside else None
        for _, k in inside:
            if decls[k].kind in CALLABLE and (after == "=" or before in ("let", "var", "const", "for") or place < (decls[k].body or 0)):
                own.setdefault(k, set()).add(t.word[i])
        if before in (".", "::", "->") or after == "(" or before in ("import", "from", "use", "package", "def", "class", "func", "fn", "function", "const", "type", "struct", "let", "var", "as"):
            continue
        if owner is not None and decls[owner].name == t.word[i] and place < (decls[owner].body or decls[owner].end):
            continue
        found.append((place, owner, t.word[i]))
    for place, owner, name in found:
        around = [k for s, e, k in spans if s <= place < e]
        if not any(name in own.get(k, ()) for k in around):
            out.append((place, owner, name))
    return out


# Names of the functions that hold tests in scripts.
_JS_TESTS = set("describe it test suite context before after beforeEach afterEach beforeAll afterAll".split())


def test_spans(t: Tokens, decls: list[Declaration]) -> list[tuple[int, int]]:
    """Ranges of inline tests."""
    out, text, lang = [], t.text, t.language
    for d in decls:
        above = text[max(0, text.rfind("\n\n", 0, d.start)) : d.start]
        if lang == "python":
            hit = d.kind in CALLABLE and re.match(r"test(_|$)", d.name) or d.kind == "class" and (d.name.startswith("Test") or re.search(r"TestCase\s*[,)]", d.signature or ""))
        elif lang == "rust":
            hit = re.search(r"#\[(?:(?:\w+::)*test|cfg\(test\))\b[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*$", text[max(0, d.start - 400) : d.start])
        elif lang == "java":
            hit = d.kind in CALLABLE and (re.search(r"@(?:Test|ParameterizedTest|RepeatedTest|Before|After)\w*\b[^;{}]*$", above) or re.match(r"test[A-Z_]", d.name)) or d.kind == "class" and re.search(r"(?:^Test|Tests?$)", d.name)
        elif lang == "go":
            hit = d.kind == "function" and re.match(r"(?:Test|Benchmark|Fuzz|Example)(?:[A-Z_]|$)", d.name)
        else:
            hit = False
        if hit:
            out.append((d.start, d.end))
    if lang in ("javascript", "typescript", "jsx", "tsx"):
        for i in range(len(t) - 1):
            if t.word[i] in _JS_TESTS and (i == 0 or t.name[i - 1] in (";", "}", "{")):
                k = i + 1
                while k + 1 < len(t) and t.name[k] == ".":
                    k += 2
                if k < len(t) and t.name[k] == "(":
                    c = t.mate.get(k, len(t) - 1)
                    c += c + 1 < len(t) and t.name[c + 1] == ";"
                    out.append((t.start[i], t.end[c]))
    return out


def offsets(text: str) -> tuple[np.ndarray | None, np.ndarray]:
    """(bytes before each character, or null where each is one; characters where lines begin)."""
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1])
    if text.isascii():
        return None, starts
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))]), starts
