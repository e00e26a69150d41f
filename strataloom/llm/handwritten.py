"""Telling machine-written, minified, third-party and data files from hand-written source.

Notices are searched in each file's head comment (the comments and blank lines before the
first code) with one multi-pattern automaton; path rules cover vendored directories,
generated outputs, lockfiles and minified suffixes; the shape of the whole text shows
minified scripts, data saved as code and tables written by programs that carry no notice.
The text is measured once per stored version and never shuffled: only its few measures
are joined to the files by hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices of programs that write code, in lower case.
GENERATED_NOTICES = [
    "@generated", "<auto-generated", "auto-generated", "autogenerated", "auto generated", "automatically generated",
    "generated automatically", "produced automatically", "automatically produced", "code generated by", "file generated by",
    "generated by", "generated from", "generated code", "machine-written", "machine-generated", "machine generated",
    "written by a program", "code generator", "-codegen", "emitted code", "emitted by", "compiled from", "output of the",
    "change that file", "edit that file", "derived from", "edits are lost", "edits will be lost", "changes will be lost", "changes are lost", "will be overwritten", "is overwritten on",
    "do not edit", "don't edit", "do not modify this file", "do not change this file", "hands off!", "checksum:",
    "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "nicht von hand bearbeiten", "nicht bearbeiten",
    "fichier produit par", "fichier généré", "généré automatiquement", "toute modification sera perdue", "ne pas modifier",
    "generado automáticamente", "generado por", "archivo generado", "no editar", "se perderán los cambios",
]
# Notices of copied projects, in lower case; they count beside a version or the project's name.
VENDORED_NOTICES = [
    "upstream copy", "upstream version", "vendored from", "vendored copy", "copied from upstream", "released under a", "released under the",
    "licensed under", "distributed with its own licen", "distributed under", "its own licence", "third-party copy", "third party copy",
    "(c) copyright", "copyright (c)",
]
# Words that say the opposite.
DENIALS = ["not generated", "not auto-generated", "hand-kept", "hand-written", "handwritten", "rewritten by hand", "written by hand", "checked in elsewhere", "inspired by"]

# Path rules, matched against the lower-case path.
VENDORED_DIRS = "(^|/)(node_modules|bower_components|jspm_packages|site-packages|third[_-]?party|3rd[_-]?party|_?vendor|extern|externals?|deps|godeps|pods)/[^/]+/"
GENERATED_DIRS = "(^|/)(gen|generated|__generated__|_generated|autogen|auto-gen|gen-src|generated-sources|generated-src|codegen-out)/"
GENERATED_NAMES = r"(_pb2(_grpc)?\.pyi?|_pb\.(m?js|ts)|_grpc_pb\.js|\.pb\.(go|cc|h|dart)|\.pb\.gw\.go|grpc\.java|outerclass\.java|\.g\.(ts|dart|cs)|\.gen\.(rs|go|ts|js|py)|[._]generated\.\w+|\.tab\.[ch]|\.yy\.[ch]|\.designer\.cs)$"
MINIFIED_NAMES = r"[.-]min\.(m?js|cjs|css)$|\.bundle\.(m?js|css)$"
LOCKFILES = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum|flake\.lock|bun\.lockb?|uv\.lock|mix\.lock|podfile\.lock)$"

_HEAD = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|endif|else|undef|line)\b)|/\*|\*|<!--|--|;|%)")
_LINE_MARK = re.compile(r'^\s*(?:#line \d+ "|//line [^\s:]+:\d+)', re.M)
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"0x[0-9A-Fa-f]+|\d+(?:\.\d+)?")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{160,}")
_QUOTED = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'')
_CODED = re.compile(r"(?:[A-Za-z0-9+/=]+|(?:\\x[0-9a-fA-F]{2})+)")
_STATEMENT = re.compile(r"[;{}]")
_DIGITS = re.compile(r"\d+")
_NUMBERED = re.compile(r"\b[A-Za-z_$][A-Za-z_$]*\d[\w$]*")
_COMMENTS = re.compile(r"/\*.*?\*/|^[ \t]*(?://|#(?!\s*(?:include|define))).*?$", re.S | re.M)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("g", GENERATED_NOTICES), ("v", VENDORED_NOTICES), ("n", DENIALS)):
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def head_comment(text: str) -> str:
    """The comments before the first code; a shebang, blank lines and closing lines of a block belong to it."""
    out, block = [], False
    for line in text.lstrip("﻿").splitlines():
        t = line.strip()
        if block or not t or _HEAD.match(line):
            out.append(t)
            if block or t.startswith("/*"):
                block = "*/" not in t
                if not block and t.rpartition("*/")[2].strip():
                    break
        elif t[:3] in ('"""', "'''"):
            # a module docstring can hold the notice too, but ends the head
            out.append(text[text.find(t[:3]) :].split(t[:3])[1])
            break
        else:
            break
    return "\n".join(out)


def measure(text: str, automaton: ahocorasick.Automaton) -> tuple[str, bool, bool, bool]:
    """(notice, minified, data, listing): which notice the head has ('g', 'v' or ''), and the shapes of the text."""
    head = head_comment(text).lower()
    hits = {k for _, k in automaton.iter(head)} if head.strip() else set()
    notice = "" if "n" in hits else "g" if "g" in hits else ""
    if not notice and "v" in hits and "n" not in hits and re.search(r"\d+\.\d+|\b(project|authors|group|maintained by|copyright)\b", head):
        notice = "v"
    body = _COMMENTS.sub("", text)
    lines = [x for x in body.splitlines() if x.strip()]
    size = sum(map(len, lines))
    if not lines or size < 200:
        return notice, False, False, False
    digits = sum(map(body.count, "0123456789"))
    longest = max(map(len, lines))
    # minified: nearly all code in very long lines that hold many statements and little blank
    minified = False
    if longest > 350:
        long = [x for x in lines if len(x) > 350]
        bare = _QUOTED.sub('""', "".join(long))
        minified = sum(map(len, long)) > 0.7 * size and len(bare) > 300
        minified = minified and bare.count(" ") < 0.08 * len(bare) and len(_STATEMENT.findall(bare)) > len(bare) / 60
    # data: numbers, quoted blobs and separators make up nearly all of it, names hardly any
    data = False
    if digits > 0.25 * size and len(_NUMBER.findall(body)) >= 60:
        data = sum(map(len, _WORD.findall(_NUMBER.sub("0 ", _QUOTED.sub('""', body))))) < 0.25 * size
    if not data and (longest >= 160 or digits > 0.06 * size):
        coded = sum(len(m) - 2 for m in _QUOTED.findall(body) if len(m) >= 34 and _CODED.fullmatch(m, 1, len(m) - 1))
        data = max(coded, sum(map(len, _BLOB.findall(body)))) > 0.6 * size
    # listing: one name or statement over and over, only numbered through
    listing = False
    if len(lines) >= 12 and digits > 0.02 * size:
        numbered = Counter(_DIGITS.sub("0", w) for w in set(_NUMBERED.findall(body)))
        most = numbered.most_common(1)[0][1] if numbered else 0
        listing = most >= 8 and most > 0.2 * len(lines)
    return notice, minified, data, listing or ("line " in text and bool(_LINE_MARK.search(text)))


def text_measures(sources: DataFrame, hash_col: str = "hash", source_col: str = "source") -> DataFrame:
    """(hash, notice, minified, data, listing) of every text; null texts have no notice and no shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton()
        for b in batches:
            m = [("", False, False, False) if t is None else measure(t, a) for t in b.column(1).to_pylist()]
            cols = list(zip(*m, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["hash", "notice", "minified", "data", "listing"]
            )

    src = sources.select(F.col(hash_col).alias("hash"), F.col(source_col).alias("source"))
    return src.mapInArrow(run, "hash string, notice string, minified boolean, data boolean, listing boolean")


def file_reason(path: Column, language: Column) -> Column:
    """Why a file is not hand-written, from its path and the measures of its text; null if it is.

    Shapes count only for programming languages and style sheets: documents, and data files
    under their own names, are not data saved as code.
    """
    p = F.lower(path)
    code = ~p.rlike(r"\.(md|markdown|rst|txt|json|jsonl|ya?ml|toml|xml|html?|csv|lock|tf)$") & F.coalesce(
        ~language.isin("markdown", "json", "yaml", "toml", "xml", "html", "terraform"), F.lit(True)
    )
    style = p.endswith(".css")
    return (
        F.when(p.rlike(LOCKFILES), "lockfile")
        .when(p.rlike(VENDORED_DIRS) | (code & (F.col("notice") == "v")), "third-party")
        .when(p.rlike(MINIFIED_NAMES) | (code & F.col("minified")), "minified")
        .when(p.rlike(GENERATED_NAMES) | p.rlike(GENERATED_DIRS) | (code & (F.col("notice") == "g")), "generated")
        .when(code & ~style & F.col("data"), "data")
        .when(code & ~style & F.col("listing"), "generated")
    )


def not_handwritten(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, path, language, source_mode, reason) for every file; reason is null for hand-written ones.

    files: repo, path, hash, language, source_mode (current rows); sources: hash, source.
    A file without a stored text is judged by its path alone; repeated file rows give
    repeated results. A null path has no reason from paths.
    """
    m = text_measures(sources).withColumnRenamed("hash", "of")
    at = files.join(m, files.hash == m.of, "left").na.fill({"notice": "", "minified": False, "data": False, "listing": False})
    reason = file_reason(F.coalesce("path", F.lit("")), F.col("language"))
    return at.select("repo", "path", "language", "source_mode", reason.alias("reason"))
