"""Splitting oversized texts at natural boundaries by recursive bisection.

A text over the limits is cut at the strongest boundary in the middle half of its bytes
(ties: the one nearest the midpoint), and halves that still exceed the limits minus the
room for their overlap are cut again. Overlaps are attached last: every piece after the
first repeats the last lines of the piece before it where they fit.

Boundaries, strongest first: before a heading, a blank line, around a fenced block, before
a list item, after a line that ends a sentence, any other line end, a line end within a
fenced block; inside a line longer than the limits a sentence end, white space, and at
last any place between two characters (never inside one, nor before a combining mark).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(\s|$)")
_ITEM = re.compile(r"\s*([-*+]|\d{1,9}[.)])\s")
_SENTENCE = re.compile(r"""(?:[.!?…]["')\]]*(?=\s)|[。！？；、，])\s*""")
_SPACE = re.compile(r"\s+")


def line_count(text: Column) -> Column:
    """Lines of a text; a final line feed starts no further line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return feeds + F.when(text.endswith("\n") | (F.length(text) == 0), 0).otherwise(1)


def _strengths(lines: list[str]) -> list[float]:
    """How well the text may be cut before each line."""
    out, fence = [], ""
    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        before = lines[i - 1] if i else ""
        if fence:
            out.append(1.0)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence, closed = "", True
                continue
        elif mark:
            out.append(5.0)
            fence = mark[1]
        elif _HEADING.match(line):
            out.append(7.0)
        elif not before.strip() and line.strip():
            out.append(6.0)
        elif i and _FENCE.match(before):
            out.append(5.0)
        elif _ITEM.match(line):
            out.append(4.0)
        elif re.search(r"[.!?。！？][\"')\]]*\s*$", before):
            out.append(3.0)
        else:
            out.append(2.0)
    return out


def _pick(places: list[tuple[int, float]], start: int, end: int) -> int | None:
    """The strongest of the (byte, strength) places in the middle half, else the one nearest the middle."""
    middle, quarter = (start + end) / 2, (end - start) / 4
    inner = [p for p in places if abs(p[0] - middle) <= quarter]
    if inner:
        return max(inner, key=lambda p: (p[1], -abs(p[0] - middle), -p[0]))[0]
    return min(places, key=lambda p: (abs(p[0] - middle), p[0]))[0] if places else None


def _inside(line: str) -> int:
    """Where to cut one long line: a position in characters."""
    sizes = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in line)]
    middle, quarter = sizes[-1] / 2, sizes[-1] / 4
    lo, hi = bisect_left(sizes, middle - quarter), bisect_left(sizes, middle + quarter)
    for pattern in (_SENTENCE, _SPACE):
        ends = [m.end() for m in pattern.finditer(line, max(0, lo - 1), min(len(line), hi + 1)) if 0 < m.end() < len(line)]
        if ends:
            return min(ends, key=lambda e: (abs(sizes[e] - middle), e))
    at = max(1, min(len(line) - 1, bisect_left(sizes, middle)))
    back = at
    while back > 1 and (unicodedata.combining(line[back]) or line[back] in "‍️" or line[back - 1] == "‍"):
        back -= 1
    return back if back > 1 else at


def split_text(text: str, max_bytes: int = 8192, max_lines: int = 120, overlap: int = 2) -> list[tuple[str, str, int]]:
    """(overlap, body, lines before the piece) of each piece; the bodies joined are ``text``.

    Repeated lines count towards the limits, which hold for overlap + body. They are left off
    only where they do not fit beside the next line, and before further pieces of a line that
    exceeds the limit itself, whose piece before is no whole line. An empty text is one empty piece.
    """
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    if size(text) <= max_bytes and len(lines) <= max_lines:
        return [("", text, 0)]
    strength = _strengths(lines)
    ends = [0, *accumulate(map(size, lines))]
    bodies: list[str] = []

    def room(first: int) -> int:
        """Bytes kept free for the lines repeated before line ``first``: none if that line does not fit beside them."""
        need = ends[first] - ends[max(0, first - overlap)]
        return need if ends[first + 1] - ends[first] + need <= max_bytes else 0

    def by_line(a: int, b: int) -> None:
        n = min(overlap, a)
        if b - a == 1 and ends[b] - ends[a] > max_bytes - room(a):
            within(lines[a], max_bytes - room(a))
        elif ends[b] - ends[a] <= max_bytes - room(a) and b - a <= max_lines - n:
            bodies.append("".join(lines[a:b]))
        else:
            byte = _pick([(ends[i], strength[i]) for i in range(a + 1, b)], ends[a], ends[b])
            # lines of zero bytes do not exist, so the byte names its line
            c = bisect_left(ends, byte)
            by_line(a, c)
            by_line(c, b)

    def within(line: str, limit: int) -> None:
        if size(line) <= limit or len(line) < 2:
            bodies.append(line)
        else:
            c = _inside(line)
            within(line[:c], limit)
            within(line[c:], limit)

    by_line(0, len(lines))
    out: list[tuple[str, str, int]] = []
    done = 0
    for body in bodies:
        again = ""
        if out and overlap:
            last = re.findall(r"[^\n]*\n|[^\n]+\Z", out[-1][0] + out[-1][1])[-overlap:]
            again = "".join(last)
            both = again + body
            if size(both) > max_bytes or len(re.findall(r"[^\n]*\n|[^\n]+\Z", both)) > max_lines:
                again = ""
        out.append((again, body, done - again.count("\n")))
        done += body.count("\n")
    return out


def split_oversized(
    df: DataFrame,
    content: str = "content",
    start_line: str = "start_line",
    end_line: str = "end_line",
    max_bytes: int = 8192,
    max_lines: int = 120,
    overlap: int = 2,
) -> DataFrame:
    """Each row of ``df`` as one row per piece; all other columns are kept.

    ``content``, ``start_line`` and ``end_line`` become those of the piece, its repeated
    lines included. Added: piece (0, 1, ...), pieces, overlap_chars (length of the
    repeated part). Rows within the limits, empty and null contents pass unchanged as
    piece 0 of 1 and never leave the JVM. A null start line leaves both lines null. Rows
    are split one by one, so repeated rows give repeated pieces. A column of ``df`` that
    is named piece, pieces or overlap_chars is replaced.
    """
    df = df.drop("piece", "pieces", "overlap_chars")
    c = F.col(content)
    over = F.coalesce((F.octet_length(c) > max_bytes) | (line_count(c) > max_lines), F.lit(False))
    small = df.where(~over).withColumns({"piece": F.lit(0), "pieces": F.lit(1), "overlap_chars": F.lit(0)})
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.IntegerType()) for n in ("piece", "pieces", "overlap_chars")]])
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("skip", "lines", "overlap_chars")]]))

    @F.pandas_udf(kind)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda t: [
                    {"text": o + b, "skip": skip, "lines": len(re.findall(r"[^\n]*\n|[^\n]+\Z", o + b)), "overlap_chars": len(o)}
                    for o, b, skip in split_text(t, max_bytes, max_lines, overlap)
                ]
            )

    # the text is cut once: the array is built before it is exploded
    cut_rows = df.where(over).select("*", pieces(c).alias("_pieces"))
    big = cut_rows.select(*[F.col(f"`{x}`") for x in df.columns], F.size("_pieces").alias("pieces"), F.posexplode("_pieces").alias("piece", "_p"))
    first = F.col(start_line) + F.col("_p.skip")
    new = {content: F.col("_p.text"), start_line: first.cast(df.schema[start_line].dataType)}
    if end_line in df.columns:
        new[end_line] = (first + F.col("_p.lines") - 1).cast(df.schema[end_line].dataType)
    big = big.withColumn("overlap_chars", F.col("_p.overlap_chars")).withColumns(new)
    return small.select(*schema.names).unionByName(big.select(*schema.names))
