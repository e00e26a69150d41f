"""Headings, chunks and keys of documents and configuration files."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from strataloom.extract.code import MAX_DEPTH, Declaration, Tokens

MAX_BYTES, MAX_LINES, MAX_PREFIX = 8192, 120, 2048


@dataclass
class Chunk:
    path: list[str]  # titles of the open headings
    start: int  # characters
    end: int
    text: str  # with the headings above it


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))] if text else []


def headings(text: str) -> list[Declaration]:
    """ATX and setext headings outside of fences, each up to the next of the same or a higher rank."""
    out: list[Declaration] = []
    fence, before = "", None
    for at in line_starts(text):
        feed = text.find("\n", at)
        line = text[at : feed if feed >= 0 else len(text)].rstrip("\r")
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)", line)
        if m and not (m[1][0] == "`" and "`" in m[2]) and not fence:
            fence, before = m[1], None
            continue
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        atx = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$", line)
        setext = re.match(r" {0,3}(=+|-+)[ \t]*$", line)
        if atx:
            title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", atx[2] or "")
            out.append(Declaration("heading", title, at + len(line) - len(line.lstrip()), len(text), level=len(atx[1])))
            before = None
        elif setext and before is not None:
            out.append(Declaration("heading", before[1], before[0], len(text), level=1 if setext[1][0] == "=" else 2))
            before = None
        elif line.strip() and not re.match(r" {4}|\t| {0,3}(?:[-*+>]|\d+[.)])\s", line):
            lead = len(line) - len(line.lstrip())
            before = (before[0], before[1] + " " + line.strip()) if before else (at + lead, line.strip())
        else:
            before = None
    open_: list[int] = []
    for i, d in enumerate(out):
        line = text.count("\n", 0, d.start) + 1
        d.name = re.sub(r"\s+", " ", d.name).strip() or f"<anonymous@{line}:{d.start - text.rfind(chr(10), 0, d.start)}>"
        while open_ and out[open_[-1]].level >= d.level:
            out[open_.pop()].end = d.start
        d.parent = open_[-1] if open_ else None
        d.scope = [*out[d.parent].scope, out[d.parent].name] if open_ else []
        open_.append(i)
    for d in out:
        d.end = d.start + len(text[d.start : d.end].rstrip())
    return out


def _bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def truncated(s: str, limit: int) -> str:
    """The longest prefix of at most ``limit`` UTF-8 bytes."""
    return s if _bytes(s) <= limit else s.encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore")


def packed(text: str, start: int, end: int, path: list[str]) -> list[Chunk]:
    """Lines of a range in chunks within the limits, each led by its headings; blank edges are cut off.

    A line that exceeds the room is divided between characters.
    """
    prefix = truncated("\n".join(f"{'#' * min(6, i + 1)} {t}" for i, t in enumerate(path)), MAX_PREFIX)
    lead = prefix + "\n\n" if prefix else ""
    room, rows = MAX_BYTES - _bytes(lead), MAX_LINES - lead.count("\n")
    out: list[Chunk] = []
    at, size, lines, begin = start, 0, 0, start

    def put(a: int, b: int) -> None:
        while a < b and (text.find("\n", a, b) >= 0 and not text[a : text.find("\n", a, b)].strip()):
            a = text.find("\n", a, b) + 1
        body = text[a:b].rstrip()
        if body.strip():
            out.append(Chunk(path, a, a + len(body), lead + body))

    while at < end:
        feed = text.find("\n", at, end)
        stop = feed + 1 if feed >= 0 else end
        line = text[at:stop]
        n = _bytes(line)
        if size and (size + n > room or lines + 1 > rows):
            put(begin, at)
            begin, size, lines = at, 0, 0
        while n > room:
            part = truncated(line, room)
            put(at, at + len(part))
            at += len(part)
            begin, line = at, line[len(part) :]
            n = _bytes(line)
        size, lines, at = size + n, lines + 1, stop
    put(begin, end)
    return out


def chunks(text: str, found: list[Declaration]) -> list[Chunk]:
    """Chunks of every section's own text, up to the next heading of any rank."""
    edges = [d.start for d in found] + [len(text)]
    out = packed(text, 0, edges[0], [])
    for d, stop in zip(found, edges[1:], strict=True):
        out += packed(text, d.start, stop, [*d.scope, d.name])
    return out


def json_keys(text: str) -> tuple[list[Declaration], list[tuple[int, str]]]:
    """Members of objects, and items of arrays that are objects or arrays themselves as [i]."""
    t = Tokens(text, "json")
    out: list[Declaration] = []

    def value_end(i: int) -> int:
        return t.mate.get(i, i if t.name[i] not in ("{", "[") else len(t) - 1)

    todo: list[tuple[int, int, int | None, list[str]]] = [(0, len(t), None, [])]
    while todo:
        i, end, parent, scope = todo.pop()
        if i >= end or t.name[i] not in ("{", "[") or len(scope) > MAX_DEPTH:
            continue
        c, k, n = value_end(i), i + 1, 0
        while k < c:
            if t.name[i] == "{" and t.name[k] == "STR" and k + 1 < c and t.name[k + 1] == ":":
                v = min(k + 2, c)
                e = min(value_end(v), c)
                name = t.word[k][1:-1]
                out.append(Declaration("item", name, t.start[k], t.end[e], parent, scope))
                todo.append((v, e + 1, len(out) - 1, [*scope, name]))
                k = e + 1
            elif t.name[i] == "[" and t.name[k] in ("{", "["):
                e = value_end(k)
                out.append(Declaration("item", f"[{n}]", t.start[k], t.end[e], parent, scope))
                todo.append((k, e + 1, len(out) - 1, [*scope, f"[{n}]"]))
                n, k = n + 1, e + 1
            else:
                n += t.name[k] == ","
                k += 1
    return out, t.faults


def yaml_keys(text: str) -> tuple[list[Declaration], list[tuple[int, str]]]:
    """Keys of mappings in block form, by indentation, each up to the last line of its value."""
    out: list[Declaration] = []
    open_: list[tuple[int, int]] = []  # (indentation, declaration)
    scalar: int | None = None
    last = 0
    for at in line_starts(text):
        feed = text.find("\n", at)
        line = text[at : feed if feed >= 0 else len(text)].rstrip("\r")
        body = line.strip()
        width = len(line) - len(line.lstrip(" "))
        if not body or body.startswith("#"):
            continue
        if scalar is not None and width > scalar:
            last = at + len(line)
            for _, i in open_:
                out[i].end = last
            continue
        scalar = None
        place = at + width
        while body.startswith("- "):
            width += len(body) - len(body[2:].lstrip())
            body = body[2:].lstrip()
            place = at + width
        m = re.match(r"(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'|([^\s\"'#\[\]{},&*!|>%@`-][^#\n]*?|-[^\s][^#\n]*?))\s*:(?=\s|$)", body)
        last = at + len(line)
        while open_ and (open_[-1][0] >= width if m else open_[-1][0] > width):
            open_.pop()
        for _, i in open_:
            out[i].end = last
        if m:
            name = next(g for g in m.groups() if g is not None) if any(g is not None for g in m.groups()) else ""
            parent = open_[-1][1] if open_ else None
            scope = [*out[parent].scope, out[parent].name] if parent is not None else []
            out.append(Declaration("item", name, place, last, parent, scope))
            open_.append((width, len(out) - 1))
            if re.match(r"[|>][-+0-9]*(?:\s+#.*)?$", body[m.end() :].strip()):
                scalar = width
    return out, []


def toml_keys(text: str) -> tuple[list[Declaration], list[tuple[int, str]]]:
    """Tables and their keys."""
    out: list[Declaration] = []
    table: int | None = None
    for m in re.finditer(r"(?m)^[ \t]*(?:\[\[?[ \t]*([^\]\n]+?)[ \t]*\]\]?|([\w.\-\"']+)[ \t]*=[ \t]*([^\n]*))", text):
        if m[1]:
            if table is not None:
                out[table].end = m.start()
            out.append(Declaration("table", m[1], m.start(), len(text)))
            table = len(out) - 1
        else:
            out.append(Declaration("item", m[2].strip("\"'"), m.start(2), m.end(), table, [out[table].name] if table is not None else []))
    return out, []


def css_rules(text: str) -> tuple[list[Declaration], list[tuple[int, str]]]:
    """Rules by their selector; rules within a block belong to it."""
    t = Tokens(text, "css")
    out: list[Declaration] = []
    todo: list[tuple[int, int, int | None, list[str]]] = [(0, len(t), None, [])]
    while todo:
        i, end, parent, scope = todo.pop()
        first = i
        while i < end:
            if t.name[i] in (";", "}"):
                first = i = i + 1
            elif t.name[i] == "{":
                c = min(t.mate.get(i, len(t) - 1), end)
                if i > first and len(scope) < MAX_DEPTH:
                    name = re.sub(r"\s+", " ", text[t.start[first] : t.end[i - 1]]).strip()
                    out.append(Declaration("rule", name, t.start[first], t.end[min(c, len(t) - 1)], parent, scope))
                    todo.append((i + 1, c, len(out) - 1, [*scope, name]))
                first = i = c + 1
            else:
                i += 1
    return out, t.faults


KEYS: dict[str, Callable[[str], tuple[list[Declaration], list[tuple[int, str]]]]] = {"json": json_keys, "yaml": yaml_keys, "toml": toml_keys, "css": css_rules}
