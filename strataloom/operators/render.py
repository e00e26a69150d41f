"""Reports as text, from tables that a limit has bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as X

_MOST = 100_000  # rows that a report can have


def _rows(df: DataFrame, *order: str) -> list:
    rows = df.orderBy(*order).limit(_MOST + 1).collect()
    if len(rows) > _MOST:
        raise ValueError(f"a report has at most {_MOST} rows: set a limit")
    return rows


def ranked_files(hits: DataFrame, limit: int = 100) -> str:
    """Hits (repo, path, start_line, end_line, name, score) by file: files by their best hit, hits by score."""
    files = hits.groupBy("repo", "path").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "repo", "path").limit(limit)
    at = hits.join(F.broadcast(files), ["repo", "path"])  # at most the limit of files
    label = X.location(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name"))
    out: list[str] = []
    last = None
    for r in at.select("repo", "path", "best", "score", label.alias("label")).orderBy(F.desc("best"), "repo", "path", F.desc("score"), "label").limit(_MOST).collect():
        if (r.repo, r.path) != last:
            out.append(f"{r.repo}/{r.path}  {r.best:.3f}")
            last = (r.repo, r.path)
        out.append(f"  {r.score:.3f}  {r.label}")
    return "\n".join(out)


def clusters(found: DataFrame) -> str:
    """Clusters (members, low, high, lines, rank, label) by rank."""
    return "\n".join(f"{r.members} members, {r.lines} lines, {r.low:.3f} to {r.high:.3f}: {r.label}" for r in _rows(found.withColumn("_o", -F.col("rank")), "_o", "label"))


def tree(entries: DataFrame, value: str = "lines") -> str:
    """Entries (entry, folder, value) of one tree, indented by depth, in the order of their paths."""
    return "\n".join(f"{'  ' * r.entry.count('/')}{r.entry.rsplit('/', 1)[-1]}{'/' if r.folder else ''}  {r[value]}" for r in _rows(entries, "entry"))


def hunks(nodes: DataFrame) -> str:
    """Nodes (path, start_line, end_line, hunk, signature, name): hunks of a file, parted by a line."""
    out: list[str] = []
    last = None
    for r in _rows(nodes, "path", "start_line", "end_line"):
        if last is None or r.path != last[0]:
            out.append(r.path)
        elif r.hunk != last[1]:
            out.append("  ...")
        out.append(f"  {r.start_line}-{r.end_line}  {r.signature or r.name}")
        last = (r.path, r.hunk)
    return "\n".join(out)
