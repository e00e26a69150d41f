"""String and path functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions by format group.
GROUPS = {
    "code": "ts mts cts tsx js mjs cjs jsx py pyi rs go java c h sh bash",
    "docs": "md markdown",
    "config": "json tf tfvars yaml yml toml",
    "markup": "xml html htm css",
}
_GROUP = {e: g for g, es in GROUPS.items() for e in es.split()}


def symbol_words(name: Column) -> Column:
    """Camel, Pascal, acronym, digit and punctuation boundaries become single blanks; lower case."""
    s = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(s, r"(\p{L})(\p{N})", "$1 $2"), r"(\p{N})(\p{L})", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))


def extension(path: Column) -> Column:
    """Extension in lower case; a dot file without a stem has none ('')."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))


def format_group(path: Column) -> Column:
    """code, docs, config or markup by extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in _GROUP.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_test_path(path: Column) -> Column:
    """Conventions for test files: a test directory, or a test prefix or suffix of the name."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|_test\.(py|go|rs|c)$|\.(test|spec)\.[cm]?[jt]sx?$|Tests?\.java$")


def under(path: Column, parent: str) -> Column:
    """Whether the path is ``parent`` or below it, by whole components; '' holds everything."""
    parent = parent.strip("/")
    return F.lit(True) & path.isNotNull() if not parent else (path == parent) | path.startswith(parent + "/")


def glob_regex(glob: str, star_crosses: bool = False) -> str:
    """Regular expression of a glob. ``*`` and ``?`` stop at ``/`` unless ``star_crosses``; ``**`` never does."""
    out, i, one = "", 0, "." if star_crosses else "[^/]"
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + one + ("*" if glob[i] == "*" else ""), i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(g, star_crosses)[1:-1] for g in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def ordered_globs(path: Column, rules: list[str], star_crosses: bool = False) -> Column:
    """The last matching rule decides; ``!`` excludes; any positive rule makes a match necessary. No rule: all match."""
    tests = [(not r.startswith("!"), path.rlike(glob_regex(r.lstrip("!"), star_crosses))) for r in rules]
    out = F.lit(not any(keep for keep, _ in tests))
    for keep, hit in tests:
        out = F.when(hit, F.lit(keep)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def path_distance(a: Column, b: Column) -> Column:
    """0 for the same file, else 1 and the hops between the two directories."""
    da, db = F.slice(F.split(a, "/"), 1, F.size(F.split(a, "/")) - 1), F.slice(F.split(b, "/"), 1, F.size(F.split(b, "/")) - 1)
    n = F.least(F.size(da), F.size(db))
    same = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(da, i - 1) != F.get(db, i - 1)), True), F.lit(0))
    common = F.when(n == 0, 0).when(same == 0, n).otherwise(same - 1)
    return F.when(a == b, 0).otherwise(1 + F.size(da) + F.size(db) - 2 * common).cast("int")


def slug(title: Column) -> Column:
    """Lower-case words joined by hyphens; a text without any becomes a hash of itself."""
    s = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.substring(F.sha2(title, 256), 1, 12)).otherwise(s)


def concise(text: Column, limit: int) -> Column:
    """White space collapsed, cut to ``limit`` characters with an ellipsis."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def inclusive_end(start_line: Column, end_line: Column, end_column: Column) -> Column:
    """Last line of a range with an exclusive end: an end at column 1 does not cover its line; never before the start."""
    end = F.coalesce(F.when(end_column == 1, end_line - 1).otherwise(end_line), start_line)
    return F.greatest(end, start_line)


def location(path: Column, start: Column, end: Column, name: Column) -> Column:
    """path:line:name or path:start-end:name."""
    lines = F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))
    return F.concat_ws(":", path, lines, name)


def common_parent(paths: Column) -> Column:
    """The deepest folder that holds all paths of an array; '' is the root."""
    low, high = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    n = F.least(F.size(low), F.size(high)) - 1
    # the smallest and the largest path part where any two do
    part = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(low, i - 1) != F.get(high, i - 1)), True), F.lit(0))
    return F.when(n <= 0, "").otherwise(F.array_join(F.slice(low, 1, F.when(part == 0, n).otherwise(part - 1).cast("int")), "/"))


def percent_encoded(path: Column) -> Column:
    """A path as it stands in a link: UTF-8 bytes other than letters, digits and ``-._~/`` become %XX."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decoded(link: Column) -> Column:
    """The inverse; a plus sign stays one. A broken escape leaves the link as it is."""
    return F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that splits no character."""
    raw = F.encode(text, "UTF-8")
    # a continuation byte (10xxxxxx) after the cut means that a character would be split
    after = lambda n: F.conv(F.hex(F.substring(raw, limit + 1 - n, 1)), 16, 10).cast("int")
    back = F.lit(3)
    for n in (2, 1, 0):
        back = F.when(F.shiftright(after(n), 6) != 2, n).otherwise(back)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(limit) - back), "UTF-8"))


def comment_prose(comment: Column) -> Column:
    """What a comment says: without its marks, the stars of its lines, and blank edges."""
    s = F.regexp_replace(comment, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?m)^[ \t]*(?:/\*+!?|//[/!]?|\*+/|\*(?!/)|#+!?|<!--|\"{3}|'{3})[ \t]?", "")
    s = F.regexp_replace(s, r"(?m)[ \t]*(?:\*+/|-->|\"{3}|'{3})[ \t]*$", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?m)[ \t]+$", ""), r"\A\s+|\s+\z", "")


def decoded_key(key: Column) -> Column:
    """A key of a configuration file as text: quotes go, and in double quotes escapes are resolved."""
    double = F.get_json_object(F.concat(F.lit('{"k":'), key, F.lit("}")), "$.k")
    single = F.replace(F.substring(key, F.lit(2), F.length(key) - 2), F.lit("''"), F.lit("'"))
    return F.when(key.rlike(r'^".*"$'), F.coalesce(double, key)).when(key.rlike(r"^'.*'$"), single).otherwise(key)


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` components, no slash at the ends; ``..`` takes one component back, null above the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    step = lambda s, p: F.when(p != "..", F.concat(s, F.array(p))).when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def closest(word: Column, known: list[str], limit: int = 3) -> Column:
    """The known word with the least edit distance up to ``limit``, ties to the first by name; null if none."""
    each = F.array(*[F.struct(F.levenshtein(F.lower(word), F.lit(k)).alias("far"), F.lit(k).alias("k")) for k in known])
    best = F.array_min(each)
    return F.when(best.far <= limit, best.k)


def unfenced_json(text: Column) -> Column:
    """The inside of a fenced json block that is the whole text, else the text itself, trimmed."""
    inside = F.regexp_extract(text, r"(?s)\A\s*```(?:json)?\s*\n(.*?)\n?\s*```\s*\z", 1)
    return F.when(inside != "", F.trim(inside)).otherwise(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
