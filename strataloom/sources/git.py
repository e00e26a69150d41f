"""What git knows of a working tree, as tables. Git runs on the driver; its output is one row a changed path."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


@dataclass
class Changes:
    """head: the commit; dirty: paths that differ from it; changed: paths that differ between the checkpoint and it."""

    head: str
    dirty: list[str]
    changed: list[str]


def changes(root: str, checkpoint: str | None) -> Changes | None:
    """What changed since the commit ``checkpoint``; null where only a full scan can tell: no checkpoint, an unknown one, or no repository."""
    try:
        head = _git(root, "rev-parse", "HEAD").decode().strip()
        if not checkpoint:
            return None
        moved = _git(root, "diff", "--name-only", "--no-renames", "-z", checkpoint, head)
        status = _git(root, "status", "--porcelain=v1", "--no-renames", "--untracked-files=all", "-z")
    except (subprocess.CalledProcessError, OSError):
        return None
    names = lambda raw: [x.decode("utf-8", "replace") for x in raw.split(b"\0") if x]
    return Changes(head, sorted({x[3:] for x in names(status)}), sorted(set(names(moved))))


def candidates(found: Changes | None, before: list[str]) -> list[str] | None:
    """Paths that a refresh looks at: dirty, changed, and dirty before, so that restored files are seen. Null is all."""
    return None if found is None else sorted({*found.dirty, *found.changed, *before})


def base_files(spark: SparkSession, root: str, commit: str, repo: str, paths: list[str]) -> DataFrame:
    """(repo, path, source) of paths at a commit; what is not there or is not UTF-8 has no row."""
    rows = []
    for p in paths:
        try:
            rows.append((repo, p, _git(root, "show", f"{commit}:{p}").decode()))
        except (subprocess.CalledProcessError, UnicodeDecodeError):
            continue
    return spark.createDataFrame(rows, "repo string, path string, source string")


def source_modes(spark: SparkSession, repo: str, found: Changes, paths: list[str]) -> DataFrame:
    """(repo, path, source_mode): working-tree for dirty paths, git for the others."""
    dirty = set(found.dirty)
    return spark.createDataFrame([(repo, p, "working-tree" if p in dirty else "git") for p in paths], "repo string, path string, source_mode string")
