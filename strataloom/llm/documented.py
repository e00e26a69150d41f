"""Functions paired with their documentation.

Texts are lexed into rows of tokens. Cumulative bracket and indentation depths make the
opening and closing token of a block neighbours within their (text, depth) window, which
delimits functions; runs of adjacent comments are islands; and lag windows attach to each
line the island that ends directly above it, to each Python definition its docstring.
What the words of a documentation say is judged last, by rules on single texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataloom.llm.lex import CODE, KEYWORD, extension_language, token_rows
from strataloom.runtime import cut

LANGUAGES = ["python", "javascript", "typescript", "jsx", "tsx", "java", "go", "rust", "c", "bash"]
_LAYOUT = [CODE[c] for c in ("NEWLINE", "INDENT", "DEDENT", ";", "EOF")]
_PY = KEYWORD["python"]
_COMPOUND = [_PY[w] for w in "async class def elif else except finally for if try while with".split()]
_DEF = [_PY["def"], _PY["async"]]

# Documentation that says nothing, matched against whole lines in lower case.
_STAND_IN = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|wip)\b[\s:!.]*(?:$|.*)|n/?a|none|nothing|undocumented|self[- ]explanatory|no (?:description|docs?|documentation|comment)s?(?: (?:yet|available|provided|given))?"
    r"|(?:missing|pending|insert|add|write|needs?) (?:a |the |some )?(?:docs?|documentation|description|docstring|comment|summary|me)(?: (?:here|later|yet))?|(?:documentation|description|docs?|summary) (?:missing|pending|here|goes here|to follow|to be (?:added|written|done))"
    r"|see (?:above|below|there|base class|parent|code|name|title)|same as above|as above|(?:auto[- ]?(?:generated )?)?stub\b.*|auto-?generated .*stub.*|generated by .*|placeholder\b.*|summary|description|documentation"
    r"|noch ohne beschreibung|ohne beschreibung|keine (?:beschreibung|dokumentation)|siehe oben|sin (?:documentar|descripción|documentación)|por documentar|pendiente|ver arriba"
)
_STOCK = re.compile(
    r"(?:an? |the |this |some |simple |small |internal |private |public |default )*(?:helper|utility|convenience|main|wrapper|callback|handler|constructor|destructor|getter|setter|accessor|initiali[sz]er|init|function|method|procedure|routine|func|fn|class|lambda)(?: (?:function|method|class|routine|constructor|for internal use|only))*"
    r"|(?:does (?:the|its|what it says)|do(?:es)? (?:stuff|things|something|work)).*"
)
_DIRECTIVE = re.compile(
    r"(?:eslint|tslint|jshint|jslint|standard|biome|deno|prettier|stylelint)[-:\s].*|nolint\b.*|noqa\b.*|pylint:.*|flake8:.*|mypy:.*|pyright:.*|pragma:.*|type:\s*ignore.*|clang-(?:format|tidy)\b.*|istanbul ignore\b.*|c8 ignore\b.*|v8 ignore\b.*"
    r"|nosec\b.*|nosonar\b.*|@ts-[\w-]+.*|ts-ignore.*|@formatter:.*|fmt:\s*(?:on|off|skip)|isort:.*|yapf:.*|rustfmt\b.*|clippy::.*|go:\w+.*|\+build .*|shellcheck \w+=.*|-\*-.*-\*-|vim?:.*|suppress\w*\b.*|checkstyle:.*|coverity.*|lint[-: ].*|#?region\b.*|#?endregion\b.*|!.*"
)
_TAG = re.compile(r"(?:\{@\w+[^}]*\}|[@\\:](?:param(?:eter)?|arg(?:ument)?|type|tparam|var|prop(?:erty)?|raises?|throws?|exception)\b\s*(?:\{[^}]*\}\s*)?(?:\[?[\w.$*]+\]?)?\s*:?\s*(?:[-–]\s*)?|[@\\:](?:see|link|since|author|version|deprecated|override|inheritdoc|private|public|protected|internal|async|static|abstract|todo|ignore|group|category|module|name|function|method|class|memberof\w*)\b.*|[@\\:]\w+:?\s*(?:\{[^}]*\}\s*)?)", re.I)
_SECTION = re.compile(r"(?:args|arguments|param(?:eter)?s?|returns?|yields?|raises|throws|examples?|notes?|see also|attributes|inputs?|outputs?)\s*:?\s*", re.I)
_PARAM = re.compile(r"[*`]{0,2}\w+[*`]{0,2}\s*(?:\([^)]*\))?\s*[:\-–]\s*")
_CODE_LINE = re.compile(r"(?:(?:[\w.\[\]\"'*&]+|(?:let|var|const|int|auto|final)\s[\w\s]+)\s*[-+*/|&]?:?=\s*[^=\s].*|(?:return|await|yield|throw|raise|print|import|from|#include)\b.*[;()\"'].*|(?:if|for|while|switch)\s*\(.*|[\w.$]+\(.*\)\s*;?\s*\{?|[{}()\[\];]+|.*[;{]|</?\w+.*>)")
_MARKER = re.compile(r"(?:nb|notes?|warning|caution|attention|important)\b[\s:!.\-–]*", re.I)
# Words that say nothing by themselves.
_EMPTY = set("a an the this that these those of to for from in on at by with and or is are be been it its as do does did can will would should function method class procedure routine helper utility description documentation doc docs documented constructor init initialize initializes inits implementation stub auto code here der die das ein eine von für und zu el la los las un una de del para y".split())


# Ranges of scripts that put no blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def clean_lines(text: str) -> list[str]:
    """The lines of a comment or docstring without its marks."""
    t = text.strip()
    m = re.match(r"(?i)[rbuft]{0,2}(\"\"\"|'''|\"|')(.*)\1\Z", t, re.S)
    if m:
        t = m[2]
    lines = []
    for x in t.splitlines():
        x = x.strip()
        x = re.sub(r"^(?:/\*+!?|\*+/|//+!?|#+!?|\*+|--+|;+|<!--)\s?", "", x)
        lines.append(re.sub(r"\s*(?:\*+/|-->)$", "", x).strip())
    return lines


def _words(text: str) -> list[str]:
    """Words in lower case; scripts without blanks give their characters in twos."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    if not text.isascii():
        text = _UNSPACED.sub(lambda m: " " + " ".join(m[0][i : i + 2] for i in range(0, len(m[0]), 2)) + " ", text)
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text)]


def _alike(a: str, b: str) -> bool:
    """The same word but for its ending."""
    if len(b) > len(a):
        a, b = b, a
    if len(b) < 3:
        return a == b
    keep = b[:-1] if len(b) > 3 and b[-1] in "ey" else b
    return a.startswith(keep) and len(a) - len(keep) <= 4


def says_something(text: str | None, name: str | None) -> bool:
    """Whether a documentation tells something about the function ``name``.

    It does not if nothing is left beside marks, separators, tags and parameter names, tool
    directives, code, stand-ins and stock phrases, or if the rest repeats the name. Null and
    empty texts say nothing; a null name is no word.
    """
    own = _words(name or "")
    said: list[str] = []
    for line in clean_lines(text or ""):
        m = _MARKER.match(line)
        line = line[m.end() :] if m and (m.end() == len(line) or m[0].rstrip()[-1:] in ":!-–.") else line
        low = line.lower().strip(" \t.!?:;,()*_`\"'…")
        if not re.search(r"[^\W\d_]", line) or _DIRECTIVE.fullmatch(line.lower()) or _STAND_IN.fullmatch(low) or _STOCK.fullmatch(low) or _CODE_LINE.fullmatch(line):
            continue
        rest = line
        tag = _TAG.match(line)
        if tag:
            rest = line[tag.end() :]
        else:
            s = _SECTION.match(line)
            if s and (s.end() == len(line) or ":" in s[0]):
                rest = line[s.end() :]
                tag = s
            p = _PARAM.match(rest)
            if p and (tag or p.end() == len(rest)):
                rest = rest[p.end() :]
        said += [w for w in _words(rest) if w not in _EMPTY]
    return len({w for w in said if not any(_alike(w, o) for o in own)}) >= 2


def token_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comments, functions) of texts (id, language, source).

    comments: id, line, text: the comment island that ends on the line directly above
    ``line``, for every line that starts with code. functions: id, language, line, end_line,
    name, docstring: every named function with a body in brackets or indented.
    """
    rows = token_rows(texts.where(F.col("language").isin(LANGUAGES)), "COMMENT|STR|IDENT", thin=True)
    k = F.col("class")
    order = Window.partitionBy("id").orderBy("pos")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    python = F.col("language") == "python"
    is_code = ~k.isin(CODE["COMMENT"], CODE["TAG"])
    step = F.when(python, F.when(k == CODE["INDENT"], 1).when(k == CODE["DEDENT"], -1)).otherwise(F.when(k == CODE["{"], 1).when(k == CODE["}"], -1))
    round_ = F.when(k.isin(CODE["("], CODE["["]), 1).when(k.isin(CODE[")"], CODE["]"]), -1).otherwise(0)
    # all windows have one partitioning and order, so the tokens are sorted once
    t = rows.withColumns({"comment": (k == CODE["COMMENT"]) & F.col("first"), "step": F.coalesce(step, F.lit(0))})
    t = t.withColumns({
        # what stands before, apart from layout tokens, and apart from comments
        "above": F.last(F.when(~k.isin(_LAYOUT), F.struct("comment", "end_line")), True).over(before),
        "prev": F.last(F.when(is_code, F.struct(k.alias("k"), "text")), True).over(before),
        "depth": F.sum("step").over(so_far), "parens": F.sum(round_).over(so_far),
        "next": F.lead(F.when(k == CODE["STR"], F.col("text"))).over(order),
        "reached": F.last(F.when(k == CODE["NEWLINE"], F.col("line")), True).over(so_far),
        "def": F.last(F.when(python & F.col("first") & k.isin(_COMPOUND), F.struct("line", k.alias("k"))), True).over(so_far),
    })
    edge = ~python & (F.col("parens") <= 0) & (k.isin(CODE["{"], CODE["}"], CODE[";"]) | ((F.col("language") == "bash") & (k == CODE["NEWLINE"])))
    t = t.withColumns({
        "near": F.col("above.comment") & (F.col("above.end_line") >= F.col("line") - 1),
        "edge": F.coalesce(edge, F.lit(False)),
        "named": F.coalesce(~python & (k == CODE["("]) & (F.col("parens") == 1) & (F.col("prev.k") == CODE["IDENT"]), F.lit(False)),
        "def_name": F.when(python & (F.col("prev.k") == _PY["def"]) & is_code, F.col("text")),
    })
    t = t.withColumns({
        "island": F.sum(F.when(F.col("comment") & ~F.coalesce("near", F.lit(False)), 1).otherwise(0)).over(so_far),
        "statement": F.sum(F.when(F.col("edge"), 1).otherwise(0)).over(before),
        "def_name": F.last("def_name", True).over(so_far),
    })
    # the first token of a statement, and its first outer parenthesis after a name
    opened = F.coalesce("statement", F.lit(0))
    t = t.withColumn("statement", opened).withColumns({
        "start": F.last(F.when(is_code & ~k.isin(_LAYOUT) & ~F.coalesce("edge", F.lit(False)), F.struct("statement", "line")), True).over(before),
        "names": F.sum(F.when(F.col("named"), 1).otherwise(0)).over(so_far),
    })
    begins = is_code & ~k.isin(_LAYOUT) & (F.col("start.statement").isNull() | (F.col("start.statement") != F.col("statement")))
    t = t.withColumn("head", F.last(F.when(begins, F.struct("line", (F.col("names") - F.when(F.col("named"), 1).otherwise(0)).alias("names"))), True).over(so_far))
    first_name = F.col("named") & (F.col("names") == F.col("head.names") + 1)
    t = t.withColumn("name", F.last(F.when(first_name, F.struct("statement", F.col("prev.text").alias("text"))), True).over(so_far))
    attached = F.col("first") & ~F.col("comment") & ~k.isin(_LAYOUT) & F.coalesce("near", F.lit(False))
    is_def = python & (k == CODE["INDENT"]) & F.col("def.k").isin(_DEF)
    is_block = ~python & (k == CODE["{"]) & (F.col("parens") == 0) & (F.col("name.statement") == F.col("statement"))
    kept = t.where(F.col("comment") | attached | (F.col("step") != 0)).select(
        "id", "language", "pos", "line", "comment", attached.alias("attached"), "island", "step",
        F.when(F.col("comment"), F.col("text")).alias("text"), (F.col("depth") + F.when(F.col("step") < 0, 1).otherwise(0)).alias("level"),
        F.when(python, F.col("reached")).otherwise(F.col("line")).alias("last_line"), F.coalesce(is_def | is_block, F.lit(False)).alias("opens"),
        F.when(python, F.col("def.line")).otherwise(F.col("head.line")).alias("head_line"),
        F.when(python, F.col("def_name")).otherwise(F.col("name.text")).alias("name"), F.when(python, F.col("next")).alias("docstring"),
    )
    kept = cut(kept)

    # comment islands, and the lines they end above
    parts = kept.where("comment").groupBy("id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    parts = parts.select("id", "island", F.array_join(F.transform("parts", lambda p: p.text), "\n").alias("text"))
    comments = kept.where("attached").select("id", "line", "island").join(parts, ["id", "island"]).select("id", "line", "text")

    # blocks: an opening and a closing token of one depth follow each other in the window of (text, depth)
    ends = kept.where("step <> 0")
    mate = Window.partitionBy("id", "level").orderBy("pos")
    ends = ends.withColumn("close", F.lead(F.struct(F.col("step").alias("s"), F.col("last_line").alias("line"))).over(mate))
    functions = ends.where(F.col("opens") & (F.col("close.s") == -1)).select(
        "id", "language", F.col("head_line").alias("line"), F.col("close.line").alias("end_line"), "name", "docstring"
    )
    return comments, functions


@F.pandas_udf(T.BooleanType())
def _says(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, names in batches:
        yield pd.Series([says_something(x, n) or says_something(y, n) for x, y, n in zip(a, b, names, strict=True)], dtype=bool)


def documented_functions(texts: DataFrame) -> DataFrame:
    """(id, line, end_line, name, text, docstring): every delimited function of texts (id, language, source).

    text is the comment island that ends on the line directly above, docstring that of Python; of functions that
    begin on one line the one that ends last holds.
    """
    comments, functions = token_documents(texts)
    last = F.max(F.struct("end_line", "name", "docstring")).alias("f")
    f = functions.groupBy("id", "line").agg(last).select("id", "line", "f.end_line", "f.name", "f.docstring")
    return f.join(comments.select("id", "line", "text"), ["id", "line"], "left").select("id", "line", "end_line", "name", "text", "docstring")


def _texts(files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the id of their text in its language, texts: id, language, source), each text once for a language."""
    at = files.select("repo", "path", "hash", extension_language(F.col("path")).alias("language")).where(F.col("language").isin(LANGUAGES))
    at = at.withColumn("id", F.concat_ws(":", "hash", "language"))
    need = at.select("id", "hash", "language").distinct()
    return at, need.join(sources.select(F.col("hash").alias("of"), "source"), F.col("hash") == F.col("of")).select("id", "language", "source")


def documented_callables(files: DataFrame, sources: DataFrame, callables: DataFrame) -> DataFrame:
    """(unit_id, repo, path, id, start_line, end_line, name, signature, description, says) of every callable of a current file.

    files: repo, path, hash (current rows); sources: hash, source; callables: unit_id, repo,
    path, name, start_line, signature. A callable is looked for among the functions that the
    windows over its text's tokens delimit, by the line on which it begins; end_line and, where
    the table has none, name are those of the function found. ``says`` is whether its
    documentation tells something. Callables of unknown languages, without a stored text, or
    that their text does not show have no end and no documentation. Exact repeats count once;
    each text is lexed once, however many files have it.
    """
    at, texts = _texts(files, sources)
    f = documented_functions(texts).withColumnRenamed("name", "own")
    c = callables.select("unit_id", "repo", "path", "name", "start_line", "signature").distinct()
    c = c.join(at.select("repo", "path", "id"), ["repo", "path"], "left")
    c = c.join(f, (c.id == f.id) & (c.start_line == f.line), "left").drop(f.id)
    c = c.withColumn("name", F.coalesce("name", "own"))
    out = c.withColumn("says", _says("text", "docstring", "name"))
    return out.select("unit_id", "repo", "path", "id", "start_line", "end_line", "name", "signature", F.concat_ws("\n", "text", "docstring").alias("description"), "says")


def pairs(files: DataFrame, sources: DataFrame, callables: DataFrame) -> DataFrame:
    """(unit_id, source, signature, description) of the callables whose documentation says something.

    source is the text from the function's first to its last line with plain line feeds, cut from the stored text.
    """
    return delimited_sources(documented_callables(files, sources, callables).where("says"), sources).select("unit_id", "source", "signature", "description")


def delimited_sources(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``documented_callables`` with ``source``, cut from the stored text by the lines of the function found.

    Each text is split once, for the distinct spans that are wanted of it, however many files and
    callables share them.
    """
    at = found.where("end_line IS NOT NULL").withColumn("of", F.substring_index("id", ":", 1))
    spans = at.select("of", "start_line", "end_line").distinct().groupBy("of").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))  # at most the functions of a text
    text = sources.select(F.col("hash").alias("of"), F.split(F.regexp_replace("source", r"\r\n?", "\n"), "\n", -1).alias("rows"))
    part = lambda x: F.struct(x.start_line.alias("start_line"), x.end_line.alias("end_line"), F.array_join(F.slice("rows", x.start_line, x.end_line - x.start_line + 1), "\n").alias("source"))
    cuts = spans.join(text, "of").select("of", F.explode(F.transform("spans", part)).alias("p")).select("of", "p.start_line", "p.end_line", "p.source")
    return at.join(cuts, ["of", "start_line", "end_line"]).select(*found.columns, "source")
