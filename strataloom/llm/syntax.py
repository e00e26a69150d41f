"""Source files that do not parse.

Texts are lexed into rows of tokens, each with its role in the grammar of the language. A
text is invalid if two adjacent tokens form no permissible pair (an anti-join against the
pairs that the productions of ``grammar`` allow), if its brackets and block words do not nest
(windows by text and depth), or if a statement lacks what its production needs (windowed
reductions over statements). For Python and JSON, whose parsers are at hand, an exact parse
of the texts found this way follows and clears those that are valid after all.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.grammar import GRAMMARS
from strataloom.llm.grammar import pairs as grammar_pairs
from strataloom.llm.lex import _LEXERS, CLASSES, CODE, KEYWORD0, KEYWORDS, extension_language, lex
from strataloom.runtime import cut, drop

_FEW = 100_000  # faulty texts up to which their places are broadcast (some 4 MB)
LANGUAGES = ["python", "javascript", "typescript", "java", "go", "rust", "c", "bash", "json", "yaml", "css"]

# Words that are reserved only in some places.
CONTEXT = {
    "javascript": "async await of get set static from as let yield accessor",
    "typescript": "async await of get set static from as let yield accessor type interface namespace module declare abstract readonly public private protected override implements is keyof infer satisfies asserts unique global enum require out",
    "java": "var record sealed permits yield non module requires exports opens when",
    "rust": "union auto macro_rules default raw gen",
    "go": "", "c": "", "python": "match case type print exec",
}
_NAMES = "CTX DNAME PNAME CNAME FNAME TNAME SNAME KEY ITEM VALUE CONT BADLINE WORD"
ROLES = [*CLASSES, *_NAMES.split()]
for _lang in LANGUAGES:
    ROLES += [w for w in KEYWORDS.get(_lang, "").split() if w not in ROLES]
ROLE = {r: i for i, r in enumerate(ROLES)}
_BY_CLASS = {lang: {KEYWORD0 + i: w for i, w in enumerate(words.split())} for lang, words in KEYWORDS.items()}
_CONTEXT = {lang: set(words.split()) for lang, words in CONTEXT.items()}
_OPENERS = {"(": 1, "[": 2, "{": 3, "if": 4, "do": 5, "case": 6}
_CLOSERS = {")": -1, "]": -2, "}": -3, "fi": -4, "done": -5, "esac": -6}

def _yaml(text: str) -> tuple[list[str], list[int]]:
    """One role per line that is not blank, a comment or within a block scalar, flow collection or quotes."""
    roles, at = [], []
    indents: list[int] = [-1]
    scalar, need, last, open_, quote = None, 0, "", 0, ""
    for i, line in enumerate(text.lstrip("﻿").split("\n")):
        line = line.rstrip("\r")
        body = line.strip()
        width = len(line) - len(line.lstrip(" "))
        if re.match(r"(?:<{7}|={7}|>{7}|\|{7})(?: |$)", line):
            roles.append("MARK"), at.append(i)
            continue
        if scalar is not None and (not body or width > scalar):
            continue
        scalar = None
        if open_ or quote:
            open_, quote = _flow(body, open_, quote)
            continue
        if not body or body.startswith("#"):
            continue
        if body in ("---", "...") or body.startswith(("--- ", "%")):
            indents, last, need = [-1], "", 0
            roles.append("BOF"), at.append(i)
            continue
        role = "VALUE"
        if line[:1] == "\t" or line[width : width + 1] == "\t":
            role = "BADLINE"
        while role != "BADLINE" and (body == "-" or body.startswith("- ")):
            inner = body[1:].lstrip()
            role = "ITEM"
            while indents[-1] > width:
                indents.pop()
            if indents[-1] < width:
                if last == "valued":
                    role = "BADLINE"
                indents.append(width)
            width += len(body) - len(inner)
            body, last = inner, "open"
            if not body:
                break
        m = re.match(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\"'\[\]{}#&*!|>%@`,?:-][^\n]*?|[?:-][^\s][^\n]*?)\s*:(?=\s|$)", body)
        if m and role != "BADLINE":
            kind = "KEY" if role == "VALUE" else role
            while indents[-1] > width:
                indents.pop()
                last = "closed"
            if indents[-1] < width:
                if last in ("valued", "closed"):
                    kind = "BADLINE"
                indents.append(width)
            role = kind
            body = body[m.end() :].strip()
            last = "open" if not body or body[0] in "#&!" else "valued"
            if ": " in re.sub(r"\"[^\"]*\"|'[^']*'|\{.*|\[.*|\s#.*", "", body) and not body.startswith(("{", "[", '"', "'", "|", ">")):
                role = "BADLINE"
        elif role == "VALUE":
            if width > max(indents[-1], -1) and (last in ("valued", "open")) and roles:
                role = "CONT"
            elif roles and not body.startswith(("{", "[", "]", "}")):
                role = "BADLINE"
            last = "valued"
        elif body:
            last = "valued"
        if re.match(r"[|>][-+0-9]*(?:\s+#.*)?$", body):
            scalar = width
        elif body:
            open_, quote = _flow(body, 0, "")
            if open_ < 0:
                role, open_ = "BADLINE", 0
        roles.append(role), at.append(i)
    if open_ or quote:
        roles.append("OPEN"), at.append(text.count("\n"))
    return roles, at


def _flow(body: str, depth: int, quote: str) -> tuple[int, str]:
    """Flow brackets left open and the quote left open after a line's value."""
    plain = not depth and not quote and body[:1] not in ("[", "{", '"', "'")
    if plain:
        return 0, ""
    j = 0
    while j < len(body):
        ch = body[j]
        if quote:
            if ch == "\\" and quote == '"':
                j += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'" and (j == 0 or body[j - 1] in " [{,:"):
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        elif ch == "#" and (j == 0 or body[j - 1] == " "):
            break
        j += 1
    return depth, quote


def _feeds(text: str) -> np.ndarray:
    """Positions of the line feeds of a text, in characters."""
    if text.isascii():
        return np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10)
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)


@lru_cache(maxsize=None)
def _tables(language: str) -> tuple[np.ndarray, np.ndarray]:
    """(role of each token class, bracket kind of each role) of a language."""
    by_class = np.zeros(KEYWORD0 + len(KEYWORDS.get(language, "").split()) + 1, np.int16)
    for i, name in enumerate(CLASSES):
        by_class[i] = ROLE[name]
    for i, name in _BY_CLASS.get(language, {}).items():
        by_class[i] = ROLE[name]
    kinds = np.zeros(len(ROLES), np.int8)
    for name, k in (_OPENERS | _CLOSERS).items():
        kinds[ROLE[name]] = k if abs(k) <= 3 or language == "bash" else 0
    return by_class, kinds


def roles_of(texts: list[str], language: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(roles, brackets, lines, tokens of each text) of the texts' tokens, BOF first and EOF last; comments have none.

    A bracket is the kind of an opening token, its negative for a closing one, else 0. The texts
    are lexed one by one; what a token's role depends on is looked up for all of them at once.
    """
    if language in ("yaml", "bash"):
        parts = [_yaml_roles(t) if language == "yaml" else _bash_roles(t) for t in texts]
        columns = (np.concatenate([np.array(p[i], t) for p in parts]) for i, t in enumerate((np.int16, np.int8, np.int32)))
        return *columns, np.array([len(p[0]) for p in parts], np.int64)
    c_, s_, e_, sizes = [], [], [], []
    for t in texts:
        c, a, b = lex(t, language)
        c_ += c
        s_ += a
        e_ += b
        sizes.append(len(c))
    n = np.array(sizes, np.int64)
    whole = "".join(texts)
    offset = np.cumsum([0, *map(len, texts)])[:-1]
    of = np.repeat(np.arange(len(texts)), n)
    cls, start, end = np.array(c_, np.int64), np.array(s_, np.int64) + offset[of], np.array(e_, np.int64) + offset[of]
    feeds = _feeds(whole)
    before = np.searchsorted(feeds, offset)
    line = np.searchsorted(feeds, start) - before[of] + 1
    keep = (cls != CODE["COMMENT"]) & (cls != CODE["TAG"])
    shebang = np.array([t.lstrip("\ufeff")[:2] == "#!" for t in texts], bool)
    keep &= ~(shebang[of] & (line == 1))
    cls, start, end, line, of = (v[keep] for v in (cls, start, end, line, of))
    n = np.bincount(of, minlength=len(texts)) + 2
    first = np.cumsum(n) - n
    at = np.arange(len(cls)) + 2 * of + 1  # BOF before and EOF after every text
    by_class, kinds = _tables(language)
    role = np.empty(n.sum(), np.int16)
    role[first], role[first + n - 1] = ROLE["BOF"], ROLE["EOF"]
    role[at] = by_class[cls]
    lines = np.empty(len(role), np.int32)
    lines[first], lines[at] = 1, line
    lines[first + n - 1] = np.diff(np.append(before, len(feeds))) + 1
    R = ROLE  # noqa: N806
    ident, word = cls == CODE["IDENT"], cls >= KEYWORD0
    js = language in ("javascript", "typescript")
    prev = role[at - 1]
    # reserved words are plain names after a dot, and as keys in scripts
    plain = np.zeros(len(cls), bool)
    if language != "python":
        plain = word & (prev == R["."])
    if js:
        bound = [R[w] for w in "function if for while switch catch super import typeof this new".split()]
        for i in np.flatnonzero(word & ((prev == R["{"]) | (prev == R[","])) & ~np.isin(role[at], bound)).tolist():
            plain[i] = whole[end[i] : end[i] + 40].lstrip()[:1] in (":", "(")
    role[at[plain]] = R["IDENT"]
    free = ident & (prev != R["."])
    context = np.zeros(len(cls), bool)
    if words := _CONTEXT.get(language, set()):
        here = np.flatnonzero(free)
        text = [whole[a:b] for a, b in zip(start[here].tolist(), end[here].tolist(), strict=True)]
        context[here] = [w in words for w in text]
        if js:  # as const
            named = np.flatnonzero(role[at] == R["const"])
            named = named[context[named - 1] & (at[named] - at[named - 1] == 1) & (named > 0)]
            role[at[[i for i in named.tolist() if whole[start[i - 1] : end[i - 1]] == "as"]]] = R["IDENT"]
        role[at[context]] = R["CTX"]
    free &= ~context
    prev = role[at - 1]

    def become(name: str, *after: str) -> None:
        nonlocal free
        hit = free & np.isin(prev, [R[w] for w in after])
        role[at[hit]] = R[name]
        free = free & ~hit

    if language == "c":
        string = free & (prev == R["STR"])
        role[at[string]] = R["SNAME"]
        hit = free & ~string & (prev == R["IDENT"]) & (role[at - 1] != R["SNAME"])
        role[at[hit]] = R["DNAME"]
        free = free & ~hit & ~string
    if js:
        become("CNAME", "const", "let", "var")
        become("PNAME", "(")
    become("FNAME", *(w for w in ("func", "fn", "function", "def") if w in R))
    if language == "go":
        become("CNAME", "const")
        become("TNAME", "type")
    elif language == "rust":
        become("CNAME", "const", "static")
        become("DNAME", "let")
        become("TNAME", "struct", "enum", "trait")
    elif language in ("java", "python"):
        become("TNAME", "class")
    return role, kinds[role], lines, n


def _yaml_roles(text: str) -> tuple[list[int], list[int], list[int]]:
    names, at = _yaml(text)
    out = ["BOF", *names, "EOF"]
    return [ROLE[r] for r in out], [0] * len(out), [1, *[a + 1 for a in at], text.count("\n") + 1]


def _bash_roles(text: str) -> tuple[list[int], list[int], list[int]]:
    """Shell: a word is reserved only where a command begins, and a parenthesis may end a pattern."""
    cls, start, _ = lex(text, "bash")
    words = _BY_CLASS["bash"]
    feeds = _feeds(text)
    line_of = (np.searchsorted(feeds, np.array(start, np.int64)) + 1).tolist() if start else []
    out, lines, kinds = ["BOF"], [1], [0]
    prev = "BOF"
    cases, inside = 0, 0  # open case words, and parentheses opened since
    shebang = text.lstrip("\ufeff")[:2] == "#!"
    for k, line in zip(cls, line_of, strict=True):
        name = words[k] if k >= KEYWORD0 else CLASSES[k]
        if name in ("COMMENT", "TAG") or (shebang and line == 1):
            continue
        if name in ("IDENT", "[", "]"):
            name = "WORD"
        elif k >= KEYWORD0:
            place = prev in ("BOF", "NEWLINE", ";", "BIN", "(", "{", "}", "then", "do", "else", "elif", "if", "while", "until", "PRE", "fi", "done", "esac", ")", "time") or (name == "in" and prev == "WORD")
            if prev == "." or (not place and not (name == "do" and prev in ("WORD", "STR"))):
                name = "IDENT" if prev == "." else "WORD"
        kind = _OPENERS.get(name, 0) or _CLOSERS.get(name, 0)
        cases += (kind == 6) - (kind == -6)
        if kind == -1 and cases and not inside:
            kind = 0  # it ends a pattern
        inside = inside + (kind == 1) - (kind == -1) if cases else 0
        out.append(name)
        kinds.append(kind)
        lines.append(line)
        prev = name
    out.append("EOF")
    kinds.append(0)
    lines.append(len(feeds) + 1)
    return [ROLE[r] for r in out], kinds, lines


def _within(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums that start anew with every text."""
    total = np.cumsum(x)
    return total - np.repeat(total[first] - x[first], n)


def _pairs() -> list[tuple[str, int, int, bool]]:
    """All permissible (language, role, next role, on a new line), computed from the productions of each grammar."""
    return [(lang, ROLE[a], ROLE[b], nl) for lang, g in GRAMMARS.items() for a, b, nl in grammar_pairs(g)]


#: What a statement needs: language, a word it holds outside of parentheses, the roles of which one must follow, and whether only the text's last statement is judged.
PRODUCTIONS = [
    *[(lang, "const", ["=", "enum", "CTX"], False) for lang in ("javascript",)], ("typescript", "const", ["=", "enum"], True),
    
    ("javascript", "function", ["{"], False), ("typescript", "function", ["{", ";"], True), ("javascript", "class", ["{"], False), ("typescript", "class", ["{"], False),
    ("java", "class", ["{", ")", ";", "STR"], False), ("java", "return", [";"], False), ("java", "throw", [";"], False), ("java", "import", [";"], False), ("java", "package", [";"], False),
    ("c", "return", [";"], False), ("c", "break", [";"], False),
    *[("rust", w, [";"], False) for w in ("use",)], *[("rust", w, [";", "{"], False) for w in ("let", "const", "static", "fn", "struct", "enum", "trait", "mod", "impl")],
    *[("python", w, [":"], False) for w in ("def", "class", "for", "while", "elif", "try", "except", "finally", "with")], ("python", "if", [":", "else"], False),
]


def invalid_texts(texts: DataFrame) -> DataFrame:
    """(id, language, line, message) of every text that is not valid, its first fault by line.

    texts: id, language, source. Languages outside of ``LANGUAGES`` and null texts are not
    judged; an empty text is valid, but in JSON.
    """
    spark = texts.sparkSession
    ends = [ROLE[x] for x in (";", "{", "}", "NEWLINE", "EOF")]
    number = {lang: i for i, lang in enumerate(LANGUAGES)}
    columns = "k1 long, k2 long, lang int, pos int, role int, kind int, line int, prev int, prev2 int, pair int, depth int, parens int, indents int, statement int, edge boolean, tried boolean"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang: dict[str, list[int]] = {}
            langs, sources = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, (lang, text) in enumerate(zip(langs, sources, strict=True)):
                if text is not None and (lang in _LEXERS or lang == "yaml"):
                    by_lang.setdefault(lang, []).append(i)
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lang, here in by_lang.items():
                r, d, line, n = roles_of([sources[i] for i in here], lang)
                first = np.cumsum(n) - n
                pos = np.arange(len(r)) - np.repeat(first, n)
                prev, prev2 = np.roll(r, 1).astype(np.int32), np.roll(r, 2).astype(np.int32)
                prev[pos < 1], prev2[pos < 2] = -1, -1
                fresh = (np.roll(line, 1) < line) & (pos > 0)
                kind = np.abs(d)
                parens = _within(np.where((kind == 1) | (kind == 2), np.sign(d), 0), first, n)
                edge = (parens <= 0) & np.isin(r, ends)
                columns = [
                    np.repeat(k1[here], n), np.repeat(k2[here], n), np.full(len(r), number[lang]), pos, r, d, line, prev, prev2, ((number[lang] * 256 + prev) * 256 + r) * 2 + fresh,
                    _within(np.sign(d).astype(np.int64), first, n), parens, _within((r == ROLE["INDENT"]).astype(np.int64) - (r == ROLE["DEDENT"]), first, n),
                    _within(edge.astype(np.int64), first, n) - edge, edge, _within((r == ROLE["try"]).astype(np.int64), first, n) > 0,
                ]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 12, pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    key = ["k1", "k2"]  # 128 bits of hash: sorted and shuffled in place of the longer id
    own = [F.xxhash64("id").alias("k1"), F.xxhash64(F.lit(7), "id").alias("k2")]
    judged = texts.where(F.col("language").isin(LANGUAGES)).select(F.col("id").cast("string").alias("id"), "language", "source").withColumns(dict(zip(key, own, strict=True)))
    # one row a token, with running sums over its text: depth of nesting, open parentheses, statements, indentation
    t = judged.select(*key, "language", "source").mapInArrow(run, columns)

    # one pass over all tokens finds the pairs that no grammar has and keeps what the other checks look at
    pairs = sorted({((number[lang] * 256 + a) * 256 + b) * 2 + n for lang, a, b, n in _pairs()})
    permitted = F.broadcast(spark.createDataFrame([(p,) for p in pairs], "permitted int"))  # fixed by the grammars
    t = t.join(permitted, F.col("pair") == F.col("permitted"), "left")
    wrong = (F.col("prev") >= 0) & F.col("permitted").isNull()  # the anti-join, within the one pass
    python = F.col("lang") == number["python"]
    colon, newline, indent = ROLE[":"], ROLE["NEWLINE"], ROLE["INDENT"]
    # Python: an indented block stands after a colon and nowhere else
    block = python & (F.col("prev") == newline) & (((F.col("prev2") == colon) & (F.col("role") != indent)) | ((F.col("prev2") != colon) & (F.col("role") == indent)))
    needs = [(number[lang], ROLE[w], [ROLE[x] for x in of], last) for lang, w, of, last in PRODUCTIONS]
    looked = {(lang, x) for lang, w, of, _ in needs for x in (w, *of)} | {(number["css"], ROLE[":"])} | {(number["python"], ROLE[w]) for w in ("try", "except", "finally")}
    look = (F.col("lang") * 1000 + F.col("role")).isin(sorted(lang * 1000 + r for lang, r in looked))
    loose = (F.col("kind") != 0) | (F.col("role") == ROLE["EOF"]) | (F.col("edge") & (F.col("lang") == number["css"]))
    block = F.coalesce(block, F.lit(False))
    # statements of Python begin here; they are looked at from the text's first try on
    begins = ~F.col("role").isin(newline, indent, ROLE["DEDENT"]) & (F.col("prev").isin(newline, indent, ROLE["DEDENT"], ROLE["BOF"]))
    tried = python & begins & F.col("tried")
    kept = t.where(wrong | loose | look | block | tried)
    both = cut(kept.select(*key, "lang", "pos", "role", "kind", "line", "depth", "indents", "parens", "statement", "prev", wrong.alias("wrong"), block.alias("block")))
    spread = both.repartition(*key)
    told = lambda df, text: df.select(*key, "line", F.lit(text).alias("message"))
    rows = spread
    faults = [told(both.where("wrong"), "Token cannot follow the one before it"), told(both.where("block"), "Block is not where it should be")]

    brackets = rows.where((F.col("kind") != 0) | (F.col("role") == ROLE["EOF"])).withColumn("level", F.col("depth") + F.when(F.col("kind") < 0, 1).otherwise(0))
    brackets = brackets.withColumn("opener", F.lag("kind").over(Window.partitionBy(*key, "level").orderBy("pos")))
    unnested = ((F.col("kind") < 0) & ~F.coalesce(F.col("opener") == -F.col("kind"), F.lit(False))) | ((F.col("role") == ROLE["EOF"]) & (F.col("depth") != 0))
    faults.append(told(brackets.where(unnested), "Brackets or blocks do not nest"))

    want = F.broadcast(spark.createDataFrame(needs, "wlang int, word int, any array<int>, last boolean"))
    word = F.when((F.col("lang") * 1000 + F.col("role")).isin(sorted({n[0] * 1000 + n[1] for n in needs})) & (F.col("parens") <= 0), F.col("role"))
    sheet = F.col("lang") == number["css"]
    parts = rows.where(~sheet & (look | (F.col("role") == ROLE["EOF"]))).groupBy(*key, "lang", "statement")
    parts = parts.agg(F.min(F.when(word.isNotNull(), F.struct("pos", word.alias("w"), "line"))).alias("head"), F.collect_set("role").alias("has"))
    lacking = parts.where("head IS NOT NULL").join(want, (F.col("lang") == F.col("wlang")) & (F.col("head.w") == F.col("word")))
    lacking = lacking.where(~F.arrays_overlap("has", "any") & (~F.col("last") | F.array_contains("has", ROLE["EOF"]))).withColumn("line", F.col("head.line"))
    faults.append(told(lacking, "Statement is not complete"))
    # style sheets: a declaration has a colon
    css = rows.where(sheet).groupBy(*key, "statement").agg(
        F.bool_or(F.col("role") == ROLE[":"]).alias("colon"), F.max_by("role", "pos").alias("ending"), F.max_by("prev", "pos").alias("before"),
        F.min("line").alias("line"), F.max(F.col("depth") + F.when(F.col("kind") < 0, 1).otherwise(0)).alias("deep"),
    )
    empty = F.col("before").isin([ROLE[x] for x in (";", "{", "}", "BOF")])
    css = css.where(F.col("ending").isin(ROLE[";"], ROLE["}"]) & ~empty & ~F.col("colon") & (F.col("deep") > 0))
    faults.append(told(css, "Statement is not complete"))
    # Python: the statement after a try block, at its depth and in its block, is a handler; a handler comes after a try
    among = lambda c, *w: F.coalesce(F.col(c).isin([ROLE[x] for x in w]), F.lit(False))
    level = Window.partitionBy(*key, "indents").orderBy("pos")
    starts = rows.where(python & begins).select(*key, "line", "role", F.lead("role").over(level).alias("next"), F.lead("prev").over(level).alias("into"), F.lag("role").over(level).alias("last"))
    open_ = among("role", "try") & (~among("next", "except", "finally") | among("into", "INDENT"))
    stray = among("role", "except", "finally") & ~among("last", "try", "except", "else")
    faults.append(told(starts.where(open_ | stray), "Statement is not complete"))

    found = reduce(DataFrame.unionByName, faults).groupBy(*key).agg(F.min(F.struct("line", "message")).alias("m"))
    found = cut(found.select(*key, "m.line", "m.message"))
    drop(both)
    few = found.limit(_FEW + 1).count() <= _FEW
    return _confirmed(judged.join(F.broadcast(found) if few else found, key).select("id", "language", "line", "message", "source"))


def _confirmed(faults: DataFrame) -> DataFrame:
    """Drops the Python and JSON texts that an exact parse accepts; ``source`` goes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for lang, text in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        ast.parse(text.lstrip("﻿")) if lang == "python" else json.loads(text.lstrip("﻿"), parse_constant=_refuse)
                    keep.append(False)
                except RecursionError:
                    keep.append(lang == "json")
                except (ValueError, SyntaxError, MemoryError):
                    keep.append(True)
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["id", "language", "line", "message"]).filter(pa.array(keep, pa.bool_()))

    exact = F.col("language").isin("python", "json")
    rest = faults.where(~exact).drop("source")
    return rest.unionByName(faults.where(exact).mapInArrow(parse, "id string, language string, line int, message string"))


def _refuse(name: str) -> None:
    raise ValueError(name)


def invalid_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, path, language, line, message) of every current file whose text is not valid.

    files: repo, path, hash, language (current rows); sources: hash, source. The syntax is
    that of the path's extension, or of ``language`` where the extension is unknown. Files of
    other languages and without a stored text are not judged. Each text is lexed once for a
    language, however many files have it.
    """
    at = files.select("repo", "path", "language", "hash", F.coalesce(extension_language(F.col("path")), "language").alias("syntax"))
    at = at.where(F.col("syntax").isin(LANGUAGES) & F.col("hash").isNotNull()).withColumn("id", F.concat_ws(":", "hash", "syntax"))
    need = at.select("id", "hash", F.col("syntax").alias("language")).distinct()
    texts = need.join(sources.select(F.col("hash").alias("of"), "source"), F.col("hash") == F.col("of")).select("id", "language", "source")
    bad = invalid_texts(texts).select(F.col("id").alias("of"), "line", "message")
    return at.join(bad, at.id == bad.of).select("repo", "path", "language", "syntax", "line", "message")
