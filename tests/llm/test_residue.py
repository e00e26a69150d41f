from strataloom.llm.residue import residue_scores, segments, train, weak_label

GOOD = [
    "Each ledger carries a weight and points back to its process. It took three attempts to reproduce it.",
    "The handler answers with 404 not found when the key is unknown, and with 403 when access is denied.",
    "Removed the lorem ipsum from the demo. The view prints the name with `{{ name }}`.",
    "Visitors without JavaScript now get a static list, so the notice that asked them to enable it is gone.",
    "Use it:\n\n```html\n<h1>{{ title }}</h1>\n<p>${BODY}</p>\n```\n\nDone.",
    "usage: tool [--size <number>] <path>",
    "1.4.2",
    "La guía explica cómo reconstruir el índice a mano.",
]
BAD = [
    "Please enable JavaScript to view this page.",
    "404 - page not found. The address may be mistyped.",
    "# About {{ project }}\n\nThe old path copied every key.",
    "The team of [INSERT NAME HERE] asked for it.",
    "Lorem ipsum dolor sit amet. Consectetur adipiscing elit sed do.",
    "Title: (write one or two sentences here)\nDetails: Your text here",
    "Seite nicht gefunden. Der Eintrag wurde gelöscht.",
]


def test_weak_labels_and_segments():
    assert segments("a `{{ x }}` b\n\n```\n{{ y }}\n```\n") == ["a c0de b"]
    assert weak_label(segments("Use {{ x }} now")[0]) is True
    assert weak_label("just a sentence.") is False
    assert segments("") == [] and segments(" \n \r\n") == []


def test_scores(spark):
    rows, i = [], 0
    for n in range(40):
        for t in GOOD + BAD:
            rows.append((i, f"{t}" if n % 2 else f"{t}\n", f"host{n}", "x"))
            i += 1
    rows += [(i, None, None, "x"), (i + 1, "", "h", "x"), (i + 2, "  \n ", "h", "x"), (i + 3, "fine words only. " * 20000 + "{{ name }}", "h", "x"), (None, "Fine.", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, segment string")
    m = train(df, "doc_id", "text", "repo")
    assert m.validation["recall"] >= 0.9 and m.validation["precision"] >= 0.9
    got = {r.key: r for r in residue_scores(df, "doc_id", "text", m).collect()}
    wrong = [rows[k][1] for k in range(i) if got[k].residue != (rows[k][1].strip() in [b.strip() for b in BAD])]
    assert not set(wrong)
    assert not any(got[k].residue for k in (i, i + 1, i + 2, None)) and got[i + 3].residue
    empty = df.limit(0)
    none = train(empty, "doc_id", "text", "repo")
    assert residue_scores(empty, "doc_id", "text", none).count() == 0
