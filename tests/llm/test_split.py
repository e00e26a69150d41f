import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.split import split_oversized, split_text


def lines(t):
    return re.findall(r"[^\n]*\n|[^\n]+\Z", t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n#`é字-", max_size=600), st.integers(40, 90), st.integers(4, 9))
def test_round_trip_and_limits(text, size, n):
    got = split_text(text, size, n)
    assert "".join(b for _, b, _ in got) == text
    at = 0
    for i, (o, b, skip) in enumerate(got):
        assert len((o + b).encode()) <= size and len(lines(o + b)) <= n
        assert skip == text[: at - len(o)].count("\n")
        if i and o:
            assert o == "".join(lines(got[i - 1][0] + got[i - 1][1])[-2:])
        at += len(b)


def test_prefers_headings_and_keeps_fences():
    text = "# A\n" + "word.\n" * 60 + "# B\n" + "word.\n" * 70
    got = split_text(text, 8192, 120)
    assert len(got) == 2 and got[1][1].startswith("# B") and got[1][0] == "word.\nword.\n"
    fenced = "x\n" * 55 + "\n```\n" + "# no heading\n" * 12 + "```\n\n" + "y\n" * 55
    assert [b.startswith("# no") for _, b, _ in split_text(fenced, 8192, 120)] == [False, False]


def test_rows(spark):
    rows = [
        (1, "a\n" * 130, ["h"], 10, 139, "p"),
        (1, "a\n" * 130, ["h"], 10, 139, "p"),
        (2, "short", None, 1, 1, "p"),
        (3, None, None, 1, 1, None),
        (4, "", None, 1, 0, None),
        (None, "é" * 9000, None, None, None, None),
        (5, "a\n" * 120, None, 1, 120, None),
        (6, "x" * 300_000, None, 7, 7, None),
    ]
    df = spark.createDataFrame(rows, "unit_id long, content string, heading_path array<string>, start_line int, end_line int, piece string")
    out = split_oversized(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.unit_id, []).append(r)
    assert len(by[1]) == 4 and {r.start_line for r in by[1] if r.piece == 0} == {10}
    second = next(r for r in by[1] if r.piece == 1)
    first = next(r for r in by[1] if r.piece == 0)
    assert second.start_line == first.end_line - 1 and second.end_line == 139 and second.heading_path == ["h"]
    assert [len(by[k]) for k in (2, 3, 4, 5)] == [1, 1, 1, 1] and by[3][0].content is None
    assert len(by[None]) > 1 and by[None][0].start_line is None
    assert max(len(r.content) for r in by[6]) <= 8192 and {r.start_line for r in by[6]} == {7}
    assert split_oversized(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["\n" * 500, " " * 20000, "字" * 5000, "á" * 6000])
def test_odd_texts(bad):
    got = split_text(bad)
    assert "".join(b for _, b, _ in got) == bad
    assert all(len((o + b).encode()) <= 8192 and len(lines(o + b)) <= 120 for o, b, _ in got)


@pytest.mark.parametrize("width", [100, 1500, 2500, 4000])
def test_overlaps_of_long_lines(width):
    # two lines are repeated wherever they fit beside a third one
    text = "".join(f"{i:04d}" + "x" * (width - 5) + "\n" for i in range(40_000 // width))
    got = split_text(text)
    assert "".join(b for _, b, _ in got) == text and len(got) > 3
    fits = 3 * width <= 8192
    assert all(len(lines(o)) == (2 if fits else 0) for o, _, _ in got[1:])
    assert all(len((o + b).encode()) <= 8192 for o, b, _ in got)
