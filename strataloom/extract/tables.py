"""Extraction as a table function: one pass over texts gives rows of all kinds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.extract.code import CALLABLE, offsets
from strataloom.extract.parse import JOINTS, parse

SCHEMA = (
    "key string, what string, id int, parent_id int, ordinal int, kind string, name string, qualified_name string, signature string, description string, attributes array<string>, "
    "scope array<string>, heading_level int, start_byte int, end_byte int, start_line int, start_column int, end_line int, end_column int, target string, alias string, wildcard boolean, text string"
)
_NAMES = [c.strip().split()[0] for c in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_TYPES = [_KINDS[c.strip().split()[1]] for c in SCHEMA.split(", ")]


def _rows(key: str, language: str | None, text: str) -> Iterator[dict]:
    p = parse(text, language)
    by, lines = offsets(text)
    at = lambda i: int(i if by is None else by[i])

    def span(a: int, b: int) -> dict:
        la, lb = (int(np.searchsorted(lines, x, "right")) for x in (a, b))
        return {"start_byte": at(a), "end_byte": at(b), "start_line": la, "end_line": lb, "start_column": at(a) - at(int(lines[la - 1])) + 1, "end_column": at(b) - at(int(lines[lb - 1])) + 1}

    ordinals: dict[int | None, int] = {}
    joint = JOINTS.get(language, ".")
    for i, d in enumerate(p.declarations):
        n = ordinals[d.parent] = ordinals.get(d.parent, -1) + 1
        yield {"what": "declaration", "id": i + 1, "parent_id": None if d.parent is None else d.parent + 1, "ordinal": n, "kind": d.kind, "name": d.name, "qualified_name": d.qualified(joint), "signature": d.signature,
               "description": d.description, "attributes": sorted(d.attributes), "scope": d.scope, "heading_level": d.level, "text": text[text.rfind("\n", 0, d.start) + 1 : d.end] if d.kind in CALLABLE else None, **span(d.start, d.end)}
    for i, m in enumerate(p.imports):
        yield {"what": "import", "id": i + 1, "target": m.path, "name": m.name, "alias": m.alias, "wildcard": m.wildcard}
    for i, (place, owner, name, receiver) in enumerate(p.calls):
        yield {"what": "call", "id": i + 1, "parent_id": None if owner is None else owner + 1, "name": name, "target": receiver, **span(place, place + len(name))}
    for i, (place, owner, name) in enumerate(p.uses):
        yield {"what": "use", "id": i + 1, "parent_id": None if owner is None else owner + 1, "name": name, **span(place, place + len(name))}
    for i, c in enumerate(p.chunks):
        yield {"what": "chunk", "id": i + 1, "scope": c.path, "text": c.text, **span(c.start, c.end)}
    for what, ranges in (("comment", p.comments), ("test", p.tests)):
        for i, (a, b) in enumerate(ranges):
            yield {"what": what, "id": i + 1, **span(a, b)}
    for i, (place, message) in enumerate(p.faults):
        yield {"what": "fault", "id": i + 1, "text": message, **span(place, place)}
    if p.description:
        yield {"what": "description", "id": 1, "text": p.description}


def extracted(texts: DataFrame, key: str = "hash", language: str = "language", source: str = "source") -> DataFrame:
    """Rows of what each text holds, told apart by ``what``.

    declaration (with kind, name, qualified_name, signature, description, attributes, scope; text is
    the source of callables), import (target, name, alias, wildcard), call (name, target is the
    receiver, parent_id the innermost callable), use (a name that the text declares or imports; parent_id the
    innermost declaration), chunk (scope is the heading path), comment and test
    (ranges), fault (text is the message), description (of the file). Null and empty texts and
    unknown languages have no rows; a text that breaks a guard has a fault instead of failing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for k, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if text:
                    rows += [{"key": k, **r} for r in _rows(k, lang, text)]
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return texts.select(F.col(key).cast("string").alias("key"), F.col(language).alias("language"), F.col(source).alias("source")).mapInArrow(run, SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def kind_of(rows: DataFrame, what: str) -> DataFrame:
    return rows.where(F.col("what") == what).drop("what")
