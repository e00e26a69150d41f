"""Template residue, filler, error pages and script notices in place of content.

A text is cut into segments (lines and sentences) outside of code, and each segment is
scored by an L2-regularised logistic regression on hashed n-grams, length and title
features. It is trained on weak labels that response statuses and phrases give, and
validated on hosts (repositories) that it has not seen. A document is a case if one of
its segments scores over the threshold and an exact check finds no sign that the segment
only speaks about such text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import cut, drop

BITS = 16

_FENCE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_CODE = re.compile(r"(`+)[^`\n](?:[^\n]*?[^`\n])?\1(?!`)")
_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FIELD = r"[^\W\d_][\w]*(?:[ _-][\w]+){0,3}"
# Delimiters of unfilled template places around a field name.
_PLACES = re.compile(
    r"\{\{\s*[#/&>^{]?\s*[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<%=?[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}"
    rf"|\[\[\s*{_FIELD}\s*\]\]|<<\s*{_FIELD}\s*>>|@@\s*{_FIELD}\s*@@|%{_FIELD}%|\$[A-Za-z]\w*(?: \w+)?\$|__[A-Za-z]\w*?(?: \w+)?__|«\s*[A-Za-z]\w*(?: \w+)?\s*»"
    rf"|\[\s*(?:insert|your|enter|add|einfügen|insertar)\b[^\]\n]{{0,60}}\]|\[\s*{_FIELD}\s*(?:goes here|here|\?)\s*\]|<\s*(?:your|insert|enter|ihr|su|tu)\b[^>\n]{{0,60}}>"
    rf"|(?<![\w$%#{{\[`])\{{\s*{_FIELD}\s*\}}(?!\}})",
    re.I,
)
# Dunder names of Python that stand in ordinary text.
_DUNDERS = {"__init__", "__main__", "__name__", "__file__", "__all__", "__doc__", "__dict__", "__class__", "__repr__", "__str__", "__call__", "__new__", "__del__", "__enter__", "__exit__", "__iter__", "__next__", "__len__", "__eq__", "__hash__", "__slots__", "__version__"}
_BARE = {"__version__"}
# Words of filler texts.
_FILLER = set("lorem ipsum dolor dolora sit amet consectetur adipiscing elit sed do eiusmod tempor tempra incididunt labore et dolore magna aliqua enim minim veniam quis nostrud ullamco ullam laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum vestibulum vestum viverra viven mauris mauri praesent praes tandor varo ferum cunar mentis qualis pellis foran sitan castu sodal sodales lacum lacus orbi ligo nisum corpus delim curabitur pellentesque fermentum".split())

# Phrases of residue (weak labels), in English, German and Spanish.
_PHRASES = [
    # response status
    r"^(?:http(?:/\d\.\d)?\s+)?(?:error\s+)?[45]\d\d\s*[-–:|]?\s*(?:error|page|not|forbidden|bad|internal|service|gateway|unauthori[sz]ed|too|request|the upstream)",
    r"^(?:page|file|site|document) (?:was )?not found\b", r"^internal server error\b", r"^access (?:is )?denied\b", r"^forbidden\b", r"^bad gateway\b",
    r"^service (?:temporarily )?unavailable\b", r"^gateway time-?out", r"^too many requests\b", r"\brequest (?:was )?blocked by\b", r"^unauthori[sz]ed\b",
    r"\bsession has expired\b", r"\bsign in again to continue\b", r"^sorry, (?:you|this page|we)\b", r"\bwe could not find what you were looking for\b",
    r"\bthis (?:site|page) can.?t be (?:reached|displayed|found)\b", r"\btook too long to respond\b", r"^(?:oops|uh-oh)\b", r"^something went wrong\b",
    r"\bwe have been notified\b", r"\bis down for maintenance\b", r"^under maintenance\b", r"\byou do not have permission to\b", r"\bupstream server sent no valid answer\b",
    r"\"status\":\s*[45]\d\d", r"\bthe document has moved\b", r"^error (?:id|code) [\w-]+\.?$", r"^seite nicht gefunden\b", r"^interner (?:server-?)?fehler\b",
    r"^zugriff verweigert\b", r"\bversuchen sie es später\b", r"^página no encontrada\b", r"^error interno\b", r"^acceso denegado\b", r"\bvuelva a intentarlo más tarde\b",
    r"\bder eintrag wurde gelöscht\b", r"^servicio no disponible\b", r"^dienst nicht verfügbar\b", r"\bdemasiadas (?:peticiones|solicitudes)\b", r"^wait \d+ seconds before retrying\b",
    # notices that scripts are required
    r"\b(?:please |must |need to )?(?:enable|turn on|activate|allow|switch on) (?:javascript|js|scripts?|scripting|cookies)\b", r"\b(?:works? best|loads?|runs?) (?:only )?with javascript\b",
    r"^(?:javascript|js|scripts? (?:is|are)) (?:is )?(?:required|disabled|turned off|needed)\b", r"\b(?:doesn.?t|does not|cannot|can.?t) (?:work|run|load|be displayed)(?: properly)? without (?:javascript|scripting|scripts?)\b",
    r"\bbrowser does not (?:run|support|allow) (?:java)?scripts?\b", r"^noscript\b", r"\bif nothing appears\b", r"\baktivieren sie (?:java)?s[ck]ript", r"\b(?:habilite|active|activa) javascript\b",
    r"\bohne skripte\b", r"\bno admite scripts\b", r"\b(?:change the setting|switch it on) (?:and reload|to continue)\b",
    # filler and forms that nobody filled in
    r"^lorem ipsum\b", r"^(?:placeholder|dummy|filler|sample|example|fake) (?:text|copy|content|paragraph|words)\b", r"\bdummy text \d* ?dummy\b", r"\bblah blah\b", r"\basdf\b",
    r"\breal copy to follow\b", r"\bexample content \d* ?only\b", r"\bto fill the space\b", r"\bswap it for your own words\b", r"\byour (?:text|title|content|name|description) (?:goes )?here\b",
    r"\bfill in before\b", r"\btext to be supplied\b", r"^(?:\w+ ?\w*: )?\W*(?:replace|delete|edit) this (?:line|text|section)\b", r"^(?:\w+ ?\w*: )?\((?:write|what|describe|explain|enter|add|escriba|beschreiben|describa|was )[^)]*\)$",
    r"\btexto de relleno\b", r"\bhier steht später\b", r"\bplatzhaltertext\b", r"\bcambiar antes de publicar\b", r"^blindtext\b",
]
_FIRST = re.compile("|".join(f"(?:{p[1:]})" for p in _PHRASES if p[0] == "^"))
_ANYWHERE = re.compile("|".join(f"(?:{p})" for p in _PHRASES if p[0] != "^"))


def _literal(pattern: str) -> list[str]:
    """Texts of which one stands in whatever a phrase matches: its longest plain run, else the words of phrases whose parts all vary."""
    plain = pattern
    while (less := re.sub(r"\([^()]*\)\??", "\0", plain)) != plain:
        plain = less
    plain = re.sub(r"\\[bwWdDsS][*+?]?|\[[^\]]*\][*+?]?|\.[*+?]?|[^\\]\?", "\0", plain)
    runs = [r for r in re.findall(r"[^\W\d_][^\W\d_ ]*(?: [^\W\d_]+)*", plain.replace("\\", "\0")) if len(r) > 3]
    return [max(runs, key=len)] if runs else ["script", "skript", "js", "cookies", "change the setting", "switch it on"]


_LITERALS = sorted({x for p in _PHRASES if p[0] != "^" for x in _literal(p)})


def _phrase(s: str) -> bool:
    """Whether a segment in lower case holds a phrase of residue; most are told by plain texts alone."""
    return _FIRST.match(s) is not None or (any(x in s for x in _LITERALS) and _ANYWHERE.search(s) is not None)


# Signs that a segment speaks about residue.
_ABOUT = re.compile(
    r"c0de|\b(?:removed?s?|removing|replaces?|replaced|instead of|came from|comes from|answers? with|returns?|returned|responds?|prints?|logs?|notice that|message|"
    r"now get|visitors|users? (?:see|saw|get|got)|when the|if the|whenever|handles?|throws?|raises?|catch(?:es)?|e\.g\.|for example|such as|called|the (?:old|new) )\b"
)
_LONG = 400  # tokens of the longest segment that is scored as a whole
_WINDOW = 48  # tokens of the windows of longer ones: in wide windows content outweighs a short residue
_TOKEN = re.compile(r"pl4ce|c0de|[^\W\d_]+|\d+|[^\w\s]")


@dataclass
class Model:
    """weights over hashed features, the intercept at the end; figures of the validation."""

    weights: np.ndarray
    validation: dict[str, float] = field(default_factory=dict)


def segments(text: str) -> list[str]:
    """Lines and sentences in lower case; code is masked, unfilled places become one word."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _CODE.sub("c0de", text)
    if "\n    " in text or "\n\t" in text:
        text = _INDENTED.sub("\n", text)

    def place(m: re.Match) -> str:
        low = m[0].lower()
        return m[0] if low in _DUNDERS - _BARE else " pl4ce "

    if re.search(r"[\[{<«@%$_]", text):
        text = _PLACES.sub(place, text)
    out = []
    for line in text.lower().split("\n"):
        line = line.strip()
        if line:
            out += _SENTENCE.split(line) if len(line) > 24 else [line]
    return [s for s in out if s]


def weak_label(segment: str) -> bool | None:
    """True for residue, False for content, None where the signs contradict each other."""
    s = segment.strip(" \t#>*-•|\"'").strip()
    words = re.findall(r"[^\W\d_]+", s)
    filler = len(words) >= 2 and sum(w in _FILLER for w in words) > 0.6 * len(words)
    strong = "pl4ce" in s or filler
    if strong or _phrase(s):
        about = _ABOUT.search(s)
        return True if strong or not about else (False if "c0de" in s or len(words) > 12 else None)
    return False


def _stands(segment: str) -> bool:
    """Whether a segment is residue itself, and does not only speak about it."""
    return "pl4ce" in segment or weak_label(segment) is True or not _ABOUT.search(segment)


def windows(segment: str) -> list[str]:
    """The segment itself, or overlapping windows that cover all tokens of one over ``_LONG`` tokens."""
    if len(segment) <= _LONG:
        return [segment]
    spans = [m.span() for m in _TOKEN.finditer(segment)]
    if len(spans) <= _LONG:
        return [segment]
    starts = [*range(0, len(spans) - _WINDOW, _WINDOW // 2), len(spans) - _WINDOW]
    return [segment[spans[i][0] : spans[i + _WINDOW - 1][1]] for i in starts]


class Features:
    """Hashed features of many segments at once, as sparse rows (columns, ends of the rows).

    Features are uni- and bigrams of generalised tokens, the share of filler words, length,
    length of the document, and title features. Tokens are hashed once a task and looked up
    after that; everything else is arithmetic on arrays.
    """

    _CACHE = 1 << 18  # tokens kept; a full cache starts anew

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def _hash(self, token: str) -> int:
        """64 bits of hash, the lowest telling whether the token is filler."""
        h = xxhash.xxh64_intdigest("0" if token.isdigit() else token) & ~1
        if len(self.ids) >= self._CACHE:
            self.ids.clear()
        self.ids[token] = h = h | (token in _FILLER)
        return h

    def rows(self, segments: list[str], at: list[int], count: list[int]) -> tuple[np.ndarray, np.ndarray]:
        known, new = self.ids, self._hash
        flat: list[int] = []
        sizes = np.empty(len(segments), np.int64)
        for i, s in enumerate(segments):
            tokens = _TOKEN.findall(s)
            sizes[i] = len(tokens)
            flat += [known.get(t) or new(t) for t in tokens]
        word = np.array(flat, np.uint64)
        row = np.repeat(np.arange(len(segments), dtype=np.uint64), sizes)
        first = np.ones(len(word), bool)
        first[1:] = row[1:] != row[:-1]
        last = np.ones(len(word), bool)
        last[:-1] = first[1:]
        edge = np.uint64(0x9E3779B97F4A7C15)
        before = np.where(first, edge, np.roll(word, 1)) if len(word) else word
        mix = lambda x, y: (x * np.uint64(0xC2B2AE3D27D4EB4F) ^ y) * np.uint64(0x9E3779B97F4A7C15)
        filler = np.bincount(row.astype(np.int64), (word & np.uint64(1)).astype(np.float64), len(segments))
        bits = lambda v, most: np.minimum(most, np.ceil(np.log2(np.asarray(v, np.float64) + 1))).astype(np.uint64)
        title = np.array([2 * (i == 0) + (s[:1] == "#") for i, s in zip(at, segments, strict=True)], np.uint64)
        own = [bits(sizes, 6) + np.uint64(100), bits(count, 5) + np.uint64(200), title + np.uint64(300), np.where(filler > 0, 4 * filler // np.maximum(sizes, 1) + 401, 400).astype(np.uint64)]
        every = np.arange(len(segments), dtype=np.uint64)
        names = [mix(word, np.uint64(1)), mix(before, word), mix(word[last], edge), *(mix(o, np.uint64(3)) for o in own)]
        of = [row, row, row[last], *([every] * len(own))]
        both = np.concatenate([r << np.uint64(BITS) | n >> np.uint64(64 - BITS) for r, n in zip(of, names, strict=True)])
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        r = (both >> np.uint64(BITS)).astype(np.int64)
        return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), np.cumsum(np.bincount(r, minlength=len(segments)))


def _fit(cols: np.ndarray, sizes: np.ndarray, y: np.ndarray, seen: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient descent over sparse rows."""
    n = 1 << BITS
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = (1 / np.sqrt(np.maximum(sizes, 1)))[row]
    weight = np.sqrt(seen)
    weight /= np.where(y, 4 * weight[y].sum(), weight[~y].sum() * 4 / 3)  # a quarter of the weight on residue
    w = np.zeros(n + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(row, value * v[cols], len(sizes)) + v[n]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(cols, value * g[row], n), g.sum()) + l2 * np.append(v[:n], 0)
        new = v - 3.5 * grad
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (old - 1) / t * (new - w)
        w = new
    return w


def scores(cols: np.ndarray, ends: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Score of every sparse row."""
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ends)), sizes)
    return np.bincount(row, w[cols], len(ends)) / np.sqrt(np.maximum(sizes, 1)) + w[-1]


def train(docs: DataFrame, key: str, text: str, host: str, max_docs: int = 20_000, max_segments: int = 30_000, l2: float = 1e-5, steps: int = 250) -> Model:
    """Fit on a bounded sample of weakly labelled segments.

    Of at most about ``max_docs`` documents (chosen by a hash of the key) at most
    ``max_segments`` distinct segments of each label are taken by priority sampling: a segment
    that occurs c times has priority c / u, with u from its hash, so frequent ones are
    always in the sample, whatever its bound. A fifth of the hosts is held out, and precision
    and recall of the weak labels there are kept in ``Model.validation``. Without labelled rows
    of both kinds the model scores all as content.
    """
    total = docs.count()
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("h")).where("t IS NOT NULL")
    some = some.withColumn("held", F.pmod(F.xxhash64("h"), F.lit(5)) == 0)
    if total > max_docs:
        some = some.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * max_docs / total))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Features()
        for b in batches:
            parts, at, count, ys, hosts = [], [], [], [], []
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole = segments(t)
                for i, s in ((i, x) for i, p in enumerate(whole) for x in windows(p)):
                    y = weak_label(s)
                    if y is not None:
                        parts.append(s), at.append(i), count.append(len(whole)), ys.append(y), hosts.append(h)
            cols, ends = hashed.rows(parts, at, count)
            f = np.split(cols.astype(np.int32), ends[:-1]) if parts else []
            seen: dict[int, list] = {}
            for y, h, x in zip(ys, hosts, f, strict=True):
                k = (xxhash.xxh64_intdigest(x.tobytes()) & ~3 | 2 * y | h) - 2**63
                if k in seen:
                    seen[k][3] += 1
                else:
                    seen[k] = [y, h, x, 1]
            rows = list(zip(*((k, *v) for k, v in seen.items()), strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["id", "y", "h", "f", "c"])

    seg = some.select("t", "held").mapInArrow(label, "id long, y boolean, h boolean, f array<int>, c long")
    seg = seg.groupBy("id", "y", "h").agg(F.first("f").alias("f"), F.sum("c").alias("c"))
    share = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) + 1) / float(1 << 20)
    seg = cut(seg.withColumn("priority", F.col("c") / share))
    rows = [r for y in (True, False) for r in seg.where(F.col("y") == y).orderBy(F.desc("priority"), "id").limit(max_segments).collect()]
    drop(seg)
    y = np.array([r.y for r in rows], bool)
    if not y.any() or y.all():
        return Model(np.append(np.zeros(1 << BITS), -1.0), {"segments": float(len(rows))})
    seen = np.array([r.c for r in rows], np.float64)
    held = np.array([r.h for r in rows], bool)
    sizes = np.array([len(r.f) for r in rows], np.int64)
    cols = np.concatenate([np.array(r.f, np.int64) for r in rows])
    in_held = np.repeat(held, sizes)
    figures = {"segments": float(len(rows)), "positive": float(y.sum())}
    if held.any() and y[~held].any() and not y[~held].all():
        w = _fit(cols[~in_held], sizes[~held], y[~held], seen[~held], l2, steps)
        got, want = scores(cols[in_held], np.cumsum(sizes[held]), w) > 0, y[held]
        hit = float((got & want).sum())
        figures |= {"unseen_hosts": float(some.where("held").select("h").distinct().count()), "precision": hit / max(float(got.sum()), 1.0), "recall": hit / max(float(want.sum()), 1.0)}
    return Model(_fit(cols, sizes, y, seen, l2, steps), figures)


def residue_scores(docs: DataFrame, key: str, text: str, model: Model, threshold: float = 0.0) -> DataFrame:
    """(key, residue, score, segment) for every row of ``docs``: the document's most suspicious segment.

    Null, empty and blank texts have no segment and are no cases. Repeated rows give
    repeated results. Texts are read whole; segments over ``_LONG`` tokens are scored in
    overlapping windows.
    """
    kind = docs.schema[key].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))  # 2**16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(np.float64)
        hashed = Features()
        for b in batches:
            parts, at, count, ends = [], [], [], []
            for t in b.column(1).to_pylist():
                whole = segments(t) if t else []
                for i, p in enumerate(whole):
                    for x in windows(p):
                        parts.append(x), at.append(i), count.append(len(whole))
                ends.append(len(parts))
            s = scores(*hashed.rows(parts, at, count), w) if parts else np.zeros(0)
            out, lo = [], 0
            for hi in ends:
                best = (False, None, None)
                if hi > lo:
                    here = np.flatnonzero(s[lo:hi] > threshold) + lo
                    # exact check: speaking about residue, without an unfilled place or filler in the segment itself
                    hit = next((i for i in here[np.argsort(-s[here], kind="stable")] if _stands(parts[i])), None)
                    best = (False, float(s[lo:hi].max()), None) if hit is None else (True, float(s[hit]), parts[hit][:200])
                out.append(best)
                lo = hi
            cols = list(zip(*out, strict=True)) or [[]] * 3
            kinds = [pa.bool_(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "residue", "score", "segment"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, residue boolean, score double, segment string")
