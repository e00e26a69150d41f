"""Descriptions by a language model behind a protocol: one conversation a file, units in order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Llm(Protocol):
    """What a provider offers: a profile's name, and the answer to the last of the messages of a conversation."""

    profile: str

    def describe(self, messages: list[str]) -> str | None: ...


class Rerank(Protocol):
    """Scores of texts for a query: (index, score), each index once."""

    def rerank(self, query: str, docs: list[str]) -> list[tuple[int, float]]: ...


def conversations(units: DataFrame, llm: Llm, max_units: int = 2000) -> DataFrame:
    """(repo, path, unit_id, description): the units of a file described one after the other, files in parallel.

    units: repo, path, unit_id, start_line, input. A file's conversation opens with its path, then takes each unit in
    source order and keeps the answers, so a later answer can build on them; an answer that is null or fails
    leaves its unit without a row and the conversation goes on. Long files are talked about in parts of
    ``max_units``, so no task holds an unbounded conversation.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("repo", "path").orderBy("start_line", "unit_id")
    parts = units.withColumn("part", F.floor((F.row_number().over(order) - 1) / max_units))

    def talk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_line", "unit_id"])
        messages = [str(rows["path"].iloc[0])]
        out = []
        for r in rows.itertuples(index=False):
            messages.append(r.input or "")
            try:
                answer = llm.describe(messages)
            except Exception:
                answer = None
            messages.append(answer or "")
            if answer:
                out.append((r.repo, r.path, r.unit_id, answer))
        return pd.DataFrame(out, columns=["repo", "path", "unit_id", "description"])

    return parts.select("repo", "path", "part", "unit_id", "start_line", "input").groupBy("repo", "path", "part").applyInPandas(talk, "repo string, path string, unit_id long, description string")


def in_batches(missing: DataFrame, run: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], key: str, batches: int, progress: Callable[[int, int], None] | None = None) -> int:
    """Work through ``missing`` in ``batches`` parts by the hash of ``key``; each part's results are appended before the next begins.

    A failure ends the work after what was appended; running it again takes up what is still missing. Returns the
    number of parts done; ``progress`` is told after each.
    """
    for n in range(batches):
        append(run(missing.where(F.pmod(F.xxhash64(key), F.lit(batches)) == n)))
        if progress:
            progress(n + 1, batches)
    return batches
