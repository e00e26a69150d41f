"""Options of the engine, from a JSON object with aliases."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

MAX_BYTES = 1 << 20

# Other spellings of options.
ALIASES = {"maxFileSize": "max_bytes", "max-file-size": "max_bytes", "minLines": "min_lines", "maxLines": "max_lines", "similarity": "min_similarity", "minSimilarity": "min_similarity", "maxSimilarity": "max_similarity", "excludeHashes": "exclude_hashes", "crossFileOnly": "cross_file_only"}


@dataclass(frozen=True)
class Options:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    formats: tuple[str, ...] = ("code", "docs")
    max_bytes: int = MAX_BYTES
    limit: int | str | None = None
    min_similarity: float = 0.3
    max_similarity: float = 2.0
    min_lines: int = 2
    max_lines: int | None = None
    matches: int = 5
    cross_file_only: bool = False
    exclude_hashes: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.max_bytes <= 0 or self.matches <= 0 or self.min_lines < 0:
            raise ValueError("sizes and counts are positive")
        if not self.min_similarity < self.max_similarity:
            raise ValueError("the similarity range is empty")
        if any(len(h) != 64 or set(h) - set("0123456789abcdef") for h in self.exclude_hashes):
            raise ValueError("hashes are 64 lower-case hexadecimal digits")


def _distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def loaded(text: str, base: Options = Options()) -> Options:
    """Options from a JSON object of at most 1 MiB over ``base``. Unknown keys are errors that name the nearest known one."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("options are larger than 1 MiB")
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("options are a JSON object")
    known = {f.name for f in fields(Options)}
    out = {}
    for key, value in given.items():
        name = ALIASES.get(key, key.replace("-", "_"))
        if name not in known:
            near = min(sorted(known), key=lambda k: _distance(name, k))
            hint = f", did you mean {near}?" if _distance(name, near) <= 3 else ""
            raise ValueError(f"unknown option {key}{hint}")
        out[name] = tuple(value) if isinstance(value, list) else value
    merged = dict(out)
    if "exclude_hashes" in merged:  # sets of both add up
        merged["exclude_hashes"] = tuple(sorted({*base.exclude_hashes, *merged["exclude_hashes"]}))
    return replace(base, **merged)
