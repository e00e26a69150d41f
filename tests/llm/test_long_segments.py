import pytest

from strataloom.llm.residue import residue_scores, segments, train, windows
from tests.llm.test_residue import BAD, GOOD


def test_windows_cover_all_tokens():
    for n in (1, 400, 401, 600, 999, 2001):
        words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n)]
        parts = windows(" ".join(words))
        assert {w for p in parts for w in p.split()} == set(words) and all(len(p.split()) <= 400 for p in parts)
        # whatever lies within 24 tokens lies whole in a window
        assert all(any(" ".join(words[i : i + 24]) in p for p in parts) for i in range(max(1, n - 23)))
    assert windows("short {{ name }}") == ["short {{ name }}"]


@pytest.mark.parametrize("after", [700, 5000])
def test_residue_after_many_tokens(spark, after):
    rows = [(f"{h}:{i}", t, f"host{h}") for h in range(40) for i, t in enumerate(GOOD + BAD)]
    fine = "row value kept after each run of the list, " * (after // 10)
    long = [("bad", fine + "please enable javascript to view this page, " + fine, "h"), ("end", fine + "please enable javascript to view this page", "h"), ("good", fine + fine, "h")]
    kind = "doc_id string, text string, repo string"
    m = train(spark.createDataFrame(rows, kind), "doc_id", "text", "repo")
    assert all(len(segments(t)) == 1 for _, t, _ in long)
    got = {r.key: r.residue for r in residue_scores(spark.createDataFrame(long, kind), "doc_id", "text", m).collect()}
    assert got == {"bad": True, "end": True, "good": False}
