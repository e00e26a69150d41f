"""Articles that cite source files: references, how fresh they are, and their ranking; links when files move."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.freshness import retained_lines

_REF = re.compile(r"[`(]([\w.@+-]+(?:/[\w.@+-]+)+|[\w.@+-]+\.\w+)(?:(?:#L|:)(\d+)(?:-L?(\d+))?)?(?:#([\w.]+))?[`)]")
_LINK = re.compile(r"(!?\[[^\]\n]*\]\()(<[^>\n]*>|[^)\s]+)((?:\s+\"[^\"\n]*\")?\))")


def references(articles: DataFrame) -> DataFrame:
    """(repo, article, path, symbol, start_line, end_line): files that articles (repo, path, source) cite in code spans and links.

    ``a/b.py:3-9`` and ``a/b.py#L3-L9`` cite lines, ``a/b.py#name`` a symbol, else the whole file (null lines).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for repo, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for m in dict.fromkeys(_REF.findall(text or "")):
                    start = int(m[1]) if m[1] else None
                    rows.append((repo, path, m[0], m[3] or None, start, int(m[2]) if m[2] else start))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["repo", "article", "path", "symbol", "start_line", "end_line"])

    return articles.select("repo", "path", "source").mapInArrow(run, "repo string, article string, path string, symbol string, start_line int, end_line int")


def cited_freshness(refs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, article, same, lines, ratio): lines of the cited ranges that stayed, of the longer version of each.

    refs: from ``references``; old, new: repo, path, source as of the article and now. A range of the old text is
    compared with the whole new text's lines in order, so edits outside of it and moves of the file's other lines cost
    nothing. A file that is gone keeps no line; an article without references is wholly fresh and has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, lines = [], []
            for a, z, was, now in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                rows = (was or "").splitlines()
                part = "\n".join(rows[(a or 1) - 1 : z or len(rows)])
                kept, _ = retained_lines(part, now or "")
                same.append(kept)
                lines.append(max(len(part.splitlines()), len((now or "").splitlines()) if a is None else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64()), pa.array(lines, pa.int64())], names=["repo", "article", "same", "lines"])

    at = refs.join(old.select("repo", "path", F.col("source").alias("was")), ["repo", "path"], "left").join(new.select("repo", "path", F.col("source").alias("now")), ["repo", "path"], "left")
    each = at.select("repo", "article", "start_line", "end_line", "was", "now").mapInArrow(run, "repo string, article string, same long, lines long")
    out = each.groupBy("repo", "article").agg(F.sum("same").alias("same"), F.sum("lines").alias("lines"))
    return out.withColumn("ratio", F.when(F.col("lines") == 0, 1.0).otherwise(F.col("same") / F.col("lines")))


def ranked_articles(scores: DataFrame, fresh: DataFrame, key: list[str], low: float = 0.0, limit: int | None = 1) -> DataFrame:
    """(key, score, ratio, rank_score): articles by 0.9 of their best section's score and 0.1 of their freshness, ties by key.

    Articles less fresh than ``low`` go before the limit is applied; one without a freshness is wholly fresh.
    """
    best = scores.groupBy(*key).agg(F.max("score").alias("score")).join(fresh.select(*key, "ratio"), key, "left").na.fill({"ratio": 1.0})
    out = best.where(F.col("ratio") >= low).withColumn("rank_score", 0.9 * F.col("score") + 0.1 * F.col("ratio")).orderBy(F.desc("rank_score"), *key)
    return out if limit is None else out.limit(limit)


def moved_links(articles: DataFrame, moves: DataFrame) -> DataFrame:
    """(repo, path, at, old_link, new_link): links in Markdown texts (repo, path, source) that must change when files move.

    moves: repo, path, new_path. Links are relative to their article, which may move itself; anchors and titles stay,
    links to other hosts, absolute ones and those outside of the tree are left alone. ``at`` is the link's place in
    characters. Each changed link is one edit; texts without any have none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for repo, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                masked = re.sub(r"(?ms)^ {0,3}(```+|~~~+).*?(?:^ {0,3}\1[^\n]*$|\Z)|`[^`\n]*`", lambda m: " " * len(m[0]), text or "")
                for m in _LINK.finditer(masked):
                    link = m[2].strip("<>")
                    target, mark, anchor = link.partition("#")
                    if target and not re.match(r"[a-z][a-z0-9+.-]*:|/", target, re.I):
                        full = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(target)))
                        if not full.startswith(".."):
                            rows.append((repo, path, m.start(2), m[2], full, mark + anchor))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["repo", "path", "at", "old_link", "target", "anchor"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for old, here, target, anchor in zip(*(b.column(i).to_pylist() for i in range(3, 7)), strict=True):
                link = quote(posixpath.relpath(target, posixpath.dirname(here) or "."), safe="/-._~()") + anchor
                out.append(f"<{unquote(link)}>" if old.startswith("<") else link)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.string())], names=["repo", "path", "at", "old_link", "new_link"])

    links = articles.where("source IS NOT NULL").select("repo", "path", "source").mapInArrow(scan, "repo string, path string, at int, old_link string, target string, anchor string")
    m = moves.select("repo", "path", "new_path").distinct()
    at = links.join(m.withColumnRenamed("new_path", "here"), ["repo", "path"], "left").join(m.select("repo", F.col("path").alias("target"), F.col("new_path").alias("there")), ["repo", "target"], "left")
    at = at.where("here IS NOT NULL OR there IS NOT NULL").select("repo", "path", "at", "old_link", F.coalesce("here", "path").alias("here"), F.coalesce("there", "target").alias("target"), "anchor")
    return at.mapInArrow(write, "repo string, path string, at int, old_link string, new_link string").where("new_link <> old_link")
