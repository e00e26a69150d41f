"""Everything a text of a known language holds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from strataloom.extract import code, markup
from strataloom.extract.code import CALLABLE, Declaration, Import
from strataloom.extract.lex import _LEXERS

# What joins the parts of a qualified name.
JOINTS = {"rust": "::", "c": "::"}
CODE = ("python", "javascript", "typescript", "jsx", "tsx", "java", "go", "rust", "c", "bash")


@dataclass
class Parsed:
    """declarations in source order; comments, tests: character ranges; calls: (place, owner, name, receiver)."""

    declarations: list[Declaration] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    calls: list[tuple[int, int | None, str, str | None]] = field(default_factory=list)
    uses: list[tuple[int, int | None, str]] = field(default_factory=list)
    chunks: list[markup.Chunk] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    tests: list[tuple[int, int]] = field(default_factory=list)
    faults: list[tuple[int, str]] = field(default_factory=list)
    description: str | None = None


def prose(comment: str) -> str:
    """What a comment says, without its marks."""
    s = re.sub(r"\r\n?", "\n", comment)
    s = re.sub(r"(?m)^[ \t]*(?:/\*+!?|//[/!]?|\*+/|\*(?!/)|#+!?)[ \t]?", "", s)
    return re.sub(r"(?m)[ \t]*\*+/[ \t]*$", "", s).strip()


def _groups(text: str, comments: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Comments that stand alone on their lines, those on adjacent lines as one: (start, end, prose)."""
    out: list[list] = []
    for a, b in comments:
        if text[text.rfind("\n", 0, a) + 1 : a].strip() or text[a:b].startswith("#!"):
            continue
        if out and re.fullmatch(r"[ \t]*\r?\n[ \t]*", text[out[-1][1] : a]):
            out[-1][1] = b
        else:
            out.append([a, b])
    # comments of a group are cleaned together, so a line's marks go wherever it begins
    return [(a, b, prose(text[a:b])) for a, b in out]


def parse(text: str, language: str | None) -> Parsed:
    """An unknown language and an empty text hold nothing. Never fails: faults are told in the result."""
    out = Parsed()
    if not text or language is None:
        return out
    if language == "markdown":
        out.declarations = markup.headings(text)
        out.chunks = markup.chunks(text, out.declarations)
    elif language in markup.KEYS:
        out.declarations, out.faults = markup.KEYS[language](text)
        order = sorted(range(len(out.declarations)), key=lambda i: (out.declarations[i].start, -out.declarations[i].end))
        place = {o: i for i, o in enumerate(order)}
        for d in out.declarations:
            d.parent = place[d.parent] if d.parent is not None else None
        out.declarations = [out.declarations[i] for i in order]
        out.chunks = markup.packed(text, 0, len(text), [])
    elif language in CODE and language in _LEXERS:
        t = code.Tokens(text, language)
        d = out.declarations = code.declarations(t)
        out.imports, out.comments = code.imports(t), t.comments
        out.tests = code.test_spans(t, d)
        out.faults = sorted(t.faults)
        out.uses = code.uses(t, d, out.imports)
        groups = _groups(text, t.comments)
        ends = np.array([b for _, b, _ in groups], np.int64)
        for x in d:
            # the group that ends right above the declaration, past its decorators
            line = text.rfind("\n", 0, x.start) + 1
            while line and re.match(r"[ \t]*(?:@|#\[)", text[text.rfind("\n", 0, line - 1) + 1 : line]):
                line = text.rfind("\n", 0, line - 1) + 1
            k = int(np.searchsorted(ends, line + 1)) - 1 if len(ends) else -1
            if k >= 0 and re.fullmatch(r"[ \t]*\r?\n", text[groups[k][1] : line]) and groups[k][2]:
                x.description = "\n".join(filter(None, (groups[k][2], x.description)))
        if groups and not text[: groups[0][0]].strip().replace("#!", "", 1).count("\n"):
            head = groups[0]
            if not any(x.start > head[1] and re.fullmatch(r"[ \t]*\r?\n[ \t]*", text[head[1] : x.start]) for x in d[:1]):
                out.description = head[2] or None
        owners = sorted((x.start, x.end, i) for i, x in enumerate(d) if x.kind in CALLABLE)
        seen: set[tuple] = set()
        for place, name, receiver in code.calls(t):
            inside = [(e - s, i) for s, e, i in owners if s <= place < e]
            owner = min(inside)[1] if inside else None
            if (owner, name, receiver) not in seen and not (owner is not None and d[owner].start <= place < (d[owner].body or 0)):
                seen.add((owner, name, receiver))
                out.calls.append((place, owner, name, receiver))
    return out
