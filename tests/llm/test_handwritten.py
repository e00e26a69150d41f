import datetime as dt

from strataloom.llm.handwritten import _automaton, head_comment, measure, not_handwritten
from strataloom.sources import current_files

A = _automaton()
CODE = "import os\n\ndef total(items):\n    out = 0\n    for item in items:\n        out += item.cost\n    return out\n" * 4


def notice(t):
    return measure(t, A)[0]


def test_notices_count_only_in_the_head():
    assert notice("// Code generated by protogen v1.2; DO NOT EDIT.\npackage x\n") == "g"
    assert notice("#!/bin/sh\n\n# @generated by tool\nA=1\n") == "g"
    assert notice("/*\n * Automatisch erzeugt aus a.xml\n */\nint a;\n") == "g"
    assert notice(CODE + '\nBANNER = "Code generated by x; DO NOT EDIT."\n') == ""
    assert notice("# The generated output is checked in elsewhere; this is the hand-kept side, do not edit.\nx = 1\n") == ""
    assert notice("/*! lib 1.2.3 | released under a permissive licence | see the lib project */\nvar a;\n") == "v"
    assert notice("# talks about licences, released under a cloud\nx = 1\n") == ""
    assert head_comment("#include <x.h>\n// later\n") == ""


def test_shapes():
    mini = '!function(e,t){"use strict";' + "".join(f"function h{i}(w){{return w.e+{i}}}" for i in range(40)) + "}();"
    assert measure(mini, A)[1:3] == (True, False)
    help_line = 'HELP = "' + "Please read the whole of this; it is long. " * 20 + '"\n'
    assert measure(CODE + help_line, A)[1:] == (False, False, False)
    blob = "const unsigned char a[] = {\n" + "    0x63, 0x57, 0xbc, 0x01, 0x09, 0x2c,\n" * 30 + "};\n"
    assert measure(blob, A)[2]
    assert measure('export default "data:x;base64,' + "aB3+" * 300 + '";\n', A)[2]
    assert measure("\n".join(f"    static final int T__{i} = {i};" for i in range(30)), A)[3]
    assert measure(CODE, A) == ("", False, False, False)
    assert measure("", A) == ("", False, False, False)


def test_files(spark):
    t = dt.datetime(2024, 1, 1)
    files = [
        ("r", "src/a.py", "h1", "python", None, t),
        ("r", "src/a.py", "gone", "python", None, t - dt.timedelta(1)),
        ("r", "src/a.py", "h1", "python", None, t),
        ("r", "node_modules/x/a.js", "nowhere", None, None, t),
        ("r", "vendors/a.js", "h1", "javascript", "git", t),
        ("r", "lib/x.min.js", None, "javascript", "git", t),
        ("r", "package-lock.json", "h1", "json", "git", t),
        ("r", "notes.md", "h2", "markdown", "git", t),
        ("r", "b.go", "h2", "go", "git", None),
        (None, None, "h2", None, None, None),
    ]
    f = spark.createDataFrame(files, "repo string, path string, hash string, language string, source_mode string, indexed_at timestamp")
    s = spark.createDataFrame([("h1", CODE), ("h2", "// @generated\npackage b\n"), ("h3", None), (None, "x")], "hash string, source string")
    cur = current_files(f, ["hash", "language", "source_mode"])
    got = {r.path: r.reason for r in not_handwritten(cur, s).collect()}
    assert got == {
        "src/a.py": None, "node_modules/x/a.js": "third-party", "vendors/a.js": None, "lib/x.min.js": "minified",
        "package-lock.json": "lockfile", "notes.md": None, "b.go": "generated", None: "generated",
    }
    assert not_handwritten(cur.limit(0), s.limit(0)).count() == 0
