"""Lexing of source texts: classes and places of their tokens. A class is a small number; ``CLASSES`` names them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

# Token classes.
CLASSES = (
    "BOF EOF IDENT NUM STR ( ) [ ] { } , ; : . = BIN AMB PRE INC => -> ? < > @ # :: .. CHAR OPEN NEWLINE INDENT DEDENT BADINDENT COMMENT MARK LIFE TAG"
).split()
CODE = {c: i for i, c in enumerate(CLASSES)}
KEYWORD0 = 64  # keywords are numbered from here, by language

# File name extensions and the language whose syntax they have.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "tsx", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "sh": "bash", "bash": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "css": "css",
    "toml": "toml", "md": "markdown", "markdown": "markdown",
}

# Reserved words.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "bash": "if then elif else fi for in do done while until case esac function select time",
    "json": "true false null",
}
KEYWORDS["typescript"] = KEYWORDS["jsx"] = KEYWORDS["tsx"] = KEYWORDS["javascript"]
KEYWORD = {lang: {w: KEYWORD0 + i for i, w in enumerate(words.split())} for lang, words in KEYWORDS.items()}

_OPS_C = r"(?P<o>>>>=|\.\.\.=?|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|&\^=|===|!==|\.\.=|<-|:=|->|=>|::|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|==|!=|<=|>=|\*\*|<<|&\^|[-+*/%&|^]=|\.\.|[-+*/%&|^!~<>=?:;,.@#(){}\[\]])"
_NUM = r"(?P<n>0[xX][0-9A-Fa-f_]+n?\w*|0[bBoO][0-7_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?\w*)"
_WORD = r"(?P<w>[^\W\d]\w*)"
_DQ = r'"(?:[^"\\\n]|\\(?:\r\n|.|\n))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:\r\n|.|\n))*'"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/"
_C_COMMENT = rf"(?P<c>//[^\n]*|{_BLOCK})"
_REST = r"(?P<open>/\*|\"|'|`)|(?P<bad>[^\s])"
_MARK = r"(?P<mark>(?m:^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z))[^\n]*)"


def _master(*parts: str) -> re.Pattern:
    return re.compile("|".join((_MARK, *parts, _REST)), re.S)


_JS = _master(_C_COMMENT, rf"(?P<s>{_DQ}|{_SQ}|`(?:[^`\\]|\\.)*`)", r"(?P<regex>(?!))", _NUM, r"(?P<w>[#]?[^\W\d$][\w$]*|\$[\w$]*)", _OPS_C)
_LEXERS = {
    "javascript": _JS, "typescript": _JS, "jsx": _JS, "tsx": _JS,
    "java": _master(_C_COMMENT, rf'(?P<s>"""(?:[^\\]|\\.)*?"""|{_DQ}|{_SQ})', _NUM, r"(?P<w>[^\W\d][\w$]*)", _OPS_C),
    "go": _master(_C_COMMENT, rf"(?P<s>{_DQ}|{_SQ}|`[^`]*`)", _NUM, _WORD, _OPS_C),
    "rust": _master(
        r"(?P<c>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)",
        r"(?P<s>b?r(?P<h>\#*)\".*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))')",
        r"(?P<life>'[^\W\d]\w*)", r"(?P<n>0[xX][0-9A-Fa-f_]+\w*|0[bo][0-7_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][-+]?[\d_]+)?\w*)", r"(?P<w>r#[^\W\d]\w*|[^\W\d]\w*)", _OPS_C,
    ),
    "c": _master(_C_COMMENT, r"(?P<pp>(?m:^)[ \t]*\#(?:[^\n\\/]|\\(?:\r?\n|.)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*)", rf"(?P<s>(?:u8|[uUL])?(?:{_DQ}|{_SQ}))", _NUM, _WORD, _OPS_C),
    "css": _master(rf"(?P<c>{_BLOCK})", rf"(?P<s>{_DQ}|{_SQ}|url\((?:[^)\"'\\]|\\.)*\))", r"(?P<n>[-+]?(?:\d*\.)?\d+(?:[eE][-+]?\d+)?(?:%|[a-zA-Z]+)?)", r"(?P<w>[#@]?-{0,2}[^\W\d][\w-]*|#[\w-]+)", r"(?P<o>::|[~|^$*]=|[-+*/!<>=:;,.&~()\[\]{}%])"),
    "json": _master(r'(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")', r"(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]))", _WORD, r"(?P<o>[,:\[\]{}])"),
    "python": _master(
        r"(?P<c>\#[^\n]*)", rf"(?P<s>(?i:[rbuft]|[rb][rb]|[rft][rft])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|{_DQ}(?!\")|{_SQ}(?!')|\"\"|''))", r"(?P<cont>\\\r?\n)", r"(?P<nl>\n)", _NUM, _WORD,
        r"(?P<o>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=|[-+*/%&|^~<>=:;,.@(){}\[\]])",
    ),
    "bash": _master(
        r"(?P<c>(?m:(?<=[\s;(])|^)\#[^\n]*)",
        r"(?P<here><<-?[ \t]*(?P<q>['\"]?)(?P<word>\w+)(?P=q)[^\n]*\n(?:.*?\n)??[ \t]*(?P=word)(?=\r?\n|\Z))",
        r"(?P<s>\$?\"(?:[^\"\\]|\\.)*\"|\$'(?:[^'\\]|\\.)*'|'[^']*'|`(?:[^`\\]|\\.)*`|\$\(\((?:[^()]|\([^()]*\))*\)\)|\$\{(?:[^{}]|\{[^{}]*\})*\}|\$[\w?#@*!$-])",
        r"(?P<cont>\\\r?\n)", r"(?P<nl>\n)", r"(?P<w>(?:[\w%+,./:@^~=!?*-]|\\.|\[\[|\]\]|(?<=\w)\[[^\]\s]*\])+|[\[\]])", r"(?P<o>\$\(|;;&?|;&|&&|\|\||\|&|[<>]\(|\d?(?:>>|>&|<&|<<<|>\||<>|[<>])|&>>?|[;&|(){}])",
    ),
}
_OPERATORS = {
    **{o: o for o in "( ) [ ] { } , ; : . => -> ? < > @ # ::".split()},
    **{o: "=" for o in "= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= //= @= := &^=".split()},
    **{o: "BIN" for o in "/ % == != === !== <= >= && || ?? ^ << ** // <- &^ ?. | >>".split()},
    **{o: "AMB" for o in "+ - * &".split()}, **{o: "PRE" for o in "! ~".split()}, **{o: "INC" for o in "++ --".split()}, **{o: ".." for o in ".. ... ..=".split()},
}
_OPERATORS["?."] = "."
_OPERATOR_CODE = {o: CODE[c] for o, c in _OPERATORS.items()}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_VALUE_END = {CODE[c] for c in ("IDENT", "NUM", "STR", ")", "]", "}", "INC")}
_JS_VALUE_WORDS = {KEYWORD["javascript"][w] for w in ("this", "super", "null", "true", "false")}
_GO_END = {CODE[c] for c in ("IDENT", "NUM", "STR", ")", "]", "}", "INC")} | {KEYWORD["go"][w] for w in ("break", "continue", "fallthrough", "return")}


def lex(text: str, language: str) -> tuple[list[int], list[int], list[int]]:
    """(classes, starts, ends) of the tokens of a text, comments included; character positions.

    Python and shell have NEWLINE tokens, Python INDENT and DEDENT, Go the semicolons that
    its line ends stand for. OPEN is a string or comment without an end (it runs to the end
    of the text), CHAR a character that no token has, MARK a conflict marker line.
    """
    find = _LEXERS[language]
    words = KEYWORD.get(language, {})
    code, ident, num, string, binary, operators = CODE, CODE["IDENT"], CODE["NUM"], CODE["STR"], CODE["BIN"], _OPERATOR_CODE
    js, go, py, sh = language in ("javascript", "typescript", "jsx", "tsx"), language == "go", language == "python", language == "bash"
    cls: list[int] = []
    start: list[int] = []
    end: list[int] = []
    at, last, nest, indents = 0, -1, 0, [0]
    if text.startswith("﻿"):
        at = 1
    line_start = True
    put_c, put_s, put_e = cls.append, start.append, end.append
    quoted = ("s", "here", "h") if language == "rust" else ("s", "here", "q", "word")
    tokens = find.finditer(text, at)
    while True:
        m = next(tokens, None)
        if m is None:
            break
        kind = m.lastgroup
        a, b = m.span()
        if go and last in _GO_END and "\n" in text[at:a]:
            put_c(code[";"]), put_s(a), put_e(a)
            last = code[";"]
        if py and line_start and kind not in ("nl", "c", "cont"):
            if not nest:
                width = 0
                for ch in text[text.rfind("\n", 0, a) + 1 : a]:
                    width = (width // 8 + 1) * 8 if ch == "\t" else 0 if ch == "\f" else width + (ch != "﻿")
                if width > indents[-1]:
                    indents.append(width)
                    put_c(code["INDENT"]), put_s(a), put_e(a)
                else:
                    while width < indents[-1]:
                        indents.pop()
                        put_c(code["DEDENT"]), put_s(a), put_e(a)
                    if width != indents[-1]:
                        put_c(code["BADINDENT"]), put_s(a), put_e(a)
            line_start = False
        if kind == "w":
            k = words.get(m[0], ident)
        elif kind == "o":
            o = m[0]
            if js and o in ("/", "/=") and last not in _VALUE_END and last not in _JS_VALUE_WORDS:
                r = _REGEX.match(text, a)
                if r:
                    put_c(string), put_s(a), put_e(r.end())
                    last, at = string, r.end()
                    tokens = find.finditer(text, at)
                    continue
            k = operators.get(o, binary)
            if py:
                if o in "([{":
                    nest += 1
                elif o in ")]}" and nest:
                    nest -= 1
        elif kind == "n":
            k = num
        elif kind in quoted:
            k = string
        elif kind == "c":
            if go and last in _GO_END and "\n" in m[0]:
                put_c(code[";"]), put_s(a), put_e(a)
                last = code[";"]
            put_c(code["COMMENT"]), put_s(a), put_e(b)
            at = b
            continue
        elif kind == "nl":
            at = b
            if py and nest:
                continue
            line_start = True
            if last != -1 and last != code["NEWLINE"]:
                put_c(code["NEWLINE"]), put_s(a), put_e(b)
                last = code["NEWLINE"]
            continue
        elif kind == "cont":
            at = b
            continue
        elif kind == "pp":
            at = b
            put_c(code["TAG"]), put_s(a), put_e(b)
            continue
        elif kind == "mark":
            k = code["MARK"]
        elif kind == "life":
            k = code["LIFE"]
        elif kind == "open":
            put_c(code["OPEN"]), put_s(a), put_e(len(text))
            break
        else:
            k = code["CHAR"]
        put_c(k), put_s(a), put_e(b)
        last, at = k, b
    n = len(text)
    if go and last in _GO_END and (not cls or cls[-1] != code["OPEN"]):
        put_c(code[";"]), put_s(n), put_e(n)
    if py:
        if last not in (-1, code["NEWLINE"]):
            put_c(code["NEWLINE"]), put_s(n), put_e(n)
        for _ in indents[1:]:
            put_c(code["DEDENT"]), put_s(n), put_e(n)
    return cls, start, end


def extension_language(path):
    """Language column from the extension of a path column (by ``EXTENSIONS``); null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, ext)
