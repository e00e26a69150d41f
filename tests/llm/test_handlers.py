from strataloom.llm.syntax import invalid_texts

TWO = "try:\n    a\nexcept A:\n    b\nexcept B:\n    c\n"
GOOD = [
    TWO, TWO + "else:\n    d\nfinally:\n    e\n", "try: a\nexcept A: b\n", "try: a; b\n# c\n\nfinally: d\n", "try:\n    try:\n        a\n    finally:\n        b\nexcept A:\n    c\n",
    "def f():\n    try:\n        if a:\n            b\n        c = [\n1]\n\n    # d\n    except* A as e:\n        pass\ntry:\n    x\nfinally:\n    y",
]
BAD = {
    TWO + "try:\n    x\ny = 1\n": 7, "try:\n    x\ny = 1\n" + TWO: 1, "try: x\ny = 1\n" + TWO: 1, TWO + "def f():\n    try:\n        x\n": 8, TWO + "try:\n    x\nelse:\n    y\n": 7,
    "try:\n    a\nexcept A:\n    b\nfinally:\n    c\ndef f():\n    try:\n        x\n    return 1\n": 8, TWO + "try:\n    try:\n        x\nexcept A:\n    y\n": 8,
    TWO + "def f():\n    try:\n        x\ndef g():\n    except A:\n        y\n": 8, TWO + "y = 1\nfinally:\n    z\n": 8,
}


def test_each_try_has_its_handler(spark):
    rows = [(f"good{i}", "python", t) for i, t in enumerate(GOOD)] + [(f"bad{i}", "python", t) for i, t in enumerate(BAD)]
    got = {r.id: r.line for r in invalid_texts(spark.createDataFrame(rows, "id string, language string, source string")).collect()}
    assert got == {f"bad{i}": line for i, line in enumerate(BAD.values())}
