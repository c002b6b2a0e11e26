"""Secret scans: fixed patterns, and a battery of randomness tests for tokens without one.

A token is a run of 20 or more characters of the base64 alphabets. Its encoding is inferred
from the characters it has (hexadecimal, base32, base36, base62, base64). Against a uniform
draw from that alphabet it is tested by a chi-squared of character classes and of equal
slices of the alphabet, by the runs above and below the alphabet's middle, and by the serial
correlation of neighbours; Fisher's method joins the four. A token that fails this battery
isn't random. Those that pass may still be ordinary text too short to fail it: its p-value is
the likelihood ratio of ordinary text against the uniform draw from its encoding's alphabet. If
the token were ordinary, the ratio would be so small with a chance of no more than itself.
Ordinary text is a chain: classes follow each other as in words, identifiers, paths and dates,
and letters as in a sample of four languages, so that the ratio weighs the use of the alphabet,
runs and neighbours at once. The tokens of a document go through the Benjamini-Hochberg
procedure, each p-value weighted by its token's length. What it lets through is added to the
spans, unless it overlaps a base one.

Results for edge cases: a null or empty text has no spans; equal texts have equal spans; a
text of any length is scanned whole. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.llm.common import fresh, text_column

#: Base kinds in their order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

#: Least joint p-value of the battery that counts as random.
RANDOM = 0.001
#: Expected share of ordinary text among the spans that are added.
FALSE = 0.001
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the narrowest: characters in order, and the lengths of the classes among them.
ENCODINGS = {
    "hex": (_DIGITS + "abcdef", (10, 6)),
    "HEX": (_DIGITS + "ABCDEF", (10, 6)),
    "base32": (_UPPER + "234567", (26, 6)),
    "base36": (_DIGITS + _LOWER, (10, 26)),
    "BASE36": (_DIGITS + _UPPER, (10, 26)),
    "base62": (_DIGITS + _UPPER + _LOWER, (10, 26, 26)),
    "base64": (_DIGITS + _UPPER + _LOWER + "+/", (10, 26, 26, 2)),
    "base64url": (_DIGITS + _UPPER + _LOWER + "-_", (10, 26, 26, 2)),
}
#: Chances in ordinary text of a lower-case letter, capital, digit or symbol (columns) after each (rows).
_FOLLOWS = ((0.92, 0.025, 0.015, 0.04), (0.44, 0.46, 0.03, 0.07), (0.1, 0.08, 0.7, 0.12), (0.5, 0.2, 0.2, 0.1))
#: Ordinary words, of which pairs of letters are counted.
_SAMPLE = """
the people who came to this country from other places were looking for work and a better life and they found that nothing
would be given without effort however much they wished it every question should have an answer which can be checked against
what is known by others since knowledge grows through discussion and quick judgement just makes people believe the wrong things
request response user name password account message server client database connection configuration value object index query
function return string number list file path directory system network process thread memory cache update delete create insert
error warning exception timeout default option project version release package module library test example javascript python
http https www index html com org net article title category image download upload search results page content view
international organization information application development environment management performance availability
die menschen die in dieses land gekommen sind haben arbeit und ein besseres leben gesucht und mussten feststellen dass ohne
anstrengung nichts zu bekommen ist obwohl sie es sich so sehr wünschten jede frage sollte eine antwort haben die man prüfen kann
gesellschaft wirtschaft verwaltung schifffahrt donaudampf verkehrsverbindung rechtsprechung zwischen zukunft möglichkeit
les gens qui sont venus dans ce pays cherchaient du travail et une vie meilleure et ils ont appris que rien ne serait donné sans
effort chaque question devrait avoir une réponse que l'on peut vérifier auprès des autres quand la connaissance grandit aujourd'hui
las personas que llegaron a este país buscaban trabajo y una vida mejor y supieron que nada se consigue sin esfuerzo cada
pregunta debe tener una respuesta que se pueda comprobar porque el conocimiento crece cuando hablamos desarrollo jugador hacia
"""
_SETS = {name: frozenset(chars) for name, (chars, _) in ENCODINGS.items()}
COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind:start:end) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def encoding_of(token: str) -> str | None:
    """The narrowest encoding with all of the token's characters; None for a number or none."""
    used = set(token)
    if used <= set(_DIGITS):
        return None
    return next((name for name, chars in _SETS.items() if used <= chars), None)


def _chi_tail(x: float, k: int) -> float:
    """P(chi-squared of k degrees > x), by the cube-root normal approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, encoding: str) -> dict[str, float]:
    """p-values under a uniform draw from the encoding's alphabet."""
    chars, classes = ENCODINGS[encoding]
    m, n = len(chars), len(token)
    at = [chars.index(c) for c in token]
    edges = [sum(classes[: k + 1]) for k in range(len(classes))]
    by_class = [0] * len(classes)
    for x in at:
        by_class[next(k for k, e in enumerate(edges) if x < e)] += 1
    if len(classes) > 3:  # the two symbols are too few to expect any
        by_class, classes = [by_class[0] + by_class[3], *by_class[1:3]], (classes[0] + classes[3], *classes[1:3])
    out = {"classes": _chi_tail(sum((o - n * c / m) ** 2 / (n * c / m) for o, c in zip(by_class, classes)), len(classes) - 1)}
    slices = max(2, min(m, n // 5))
    counts = [0] * slices
    for x in at:
        counts[x * slices // m] += 1
    expected = [n * len(range(-(-k * m // slices), -(-(k + 1) * m // slices))) / m for k in range(slices)]
    out["uniform"] = _chi_tail(sum((o - e) ** 2 / e for o, e in zip(counts, expected)), slices - 1)
    above = [2 * x >= m for x in at]
    ones = sum(above)
    zeros = n - ones
    runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
    mean = 1 + 2 * ones * zeros / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    out["runs"] = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    mid = sum(at) / n
    square = sum((x - mid) ** 2 for x in at)
    serial = sum((a - mid) * (b - mid) for a, b in zip(at, at[1:])) / square if square else 1.0
    out["serial"] = _two_sided((serial + 1 / n) * math.sqrt(n))
    return out


def joint(p_values) -> float:
    """Fisher's method."""
    p = [max(x, 1e-300) for x in p_values]
    half = -sum(map(math.log, p))
    term = total = 1.0
    for k in range(1, len(p)):
        term *= half / k
        total += term
    return math.exp(-half) * total


def _letter_logs() -> dict[str, float]:
    """Of each pair of letters, and of each letter alone as the first: the logarithm of its chance."""
    words = re.findall("[a-z]+", _SAMPLE.lower())
    one, two = Counter("".join(words)), Counter(a + b for w in words for a, b in zip(w, w[1:]))
    total = sum(one.values()) + len(_LOWER)
    alone = {c: (one[c] + 1) / total for c in _LOWER}
    after = {c: sum(two[c + d] for d in _LOWER) for c in _LOWER}
    pair = {c + d: (two[c + d] + 10 * alone[d]) / (after[c] + 10) for c in _LOWER for d in _LOWER}
    return {x: math.log(p) for x, p in (alone | pair).items()}


_LETTERS = _letter_logs()
_CLASS = {c: k for k, chars in enumerate((_LOWER, _UPPER, _DIGITS, "+/_-")) for c in chars}
_CLASS_LOGS = [[math.log(p) for p in row] for row in _FOLLOWS]


def ordinary(token: str) -> float:
    """The logarithm of the token's likelihood in ordinary text."""
    total, before, letter = 0.0, 3, ""
    for c, low in zip(token, token.lower()):
        kind = _CLASS[c]
        total += _CLASS_LOGS[before][kind]
        total += _LETTERS[letter + low] if kind < 2 else -math.log(10 if kind == 2 else 4)
        before, letter = kind, low if kind < 2 else ""
    return total


def p_value(token: str) -> float:
    """Of the token as ordinary text; 1 for one that isn't random or has no encoding."""
    encoding = encoding_of(token)
    if encoding is None or _UUID.fullmatch(token):
        return 1.0
    ratio = ordinary(token) + len(token) * math.log(len(ENCODINGS[encoding][0]))
    if ratio >= 0:
        return 1.0
    return math.exp(ratio) if joint(battery(token, encoding).values()) >= RANDOM else 1.0


def discoveries(tokens: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The (start, end) of those that are secrets, by the weighted Benjamini-Hochberg procedure.

    It covers all tokens of the document; weights are lengths over their mean.
    """
    if not tokens:
        return []
    mean = sum(len(t) for _, _, t in tokens) / len(tokens)
    ranked = sorted((p_value(t) * mean / len(t), start, end) for start, end, t in tokens)
    last = max((k for k, x in enumerate(ranked, 1) if x[0] <= FALSE * k / len(ranked)), default=0)
    return [(start, end) for _, start, end in ranked[:last]]


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans: (start, end, kind's place)."""
    base = base_spans(text)
    tokens = [(m.start(), m.end(), m[0].rstrip("=")) for m in _TOKEN.finditer(text)]
    # base spans by start, and how far those up to each reach: one that begins before a token's end and reaches past its start overlaps it
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    added = [(a, b, len(KINDS)) for a, b in discoveries(tokens) if not (k := bisect_left(starts, b)) or reach[k - 1] <= a]
    return base, sorted(base + added, key=lambda x: (x[0], x[2]))


def _written(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "random")
    return ",".join(f"{names[k]}:{a}:{b}" for a, b, k in spans)


def scan(text: str | None) -> tuple:
    """The values of COLUMNS for one text."""
    base, spans = spans_of(text or "")
    n = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
    return *n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in spans_of(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and COLUMNS."""
    column = text_column(lambda texts: [scan(t) for t in texts], COLUMNS)
    return docs.select("doc_id", column(F.col("text")).alias("s")).select("doc_id", "s.*")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without secrets in text; n_chars, where there is one, follows it."""
    column = text_column(lambda texts: [(redact(t),) for t in texts], "text string")
    s = fresh(docs, "redacted")
    out = docs.withColumn(s, column(F.col("text")))
    changed = {"text": F.col(s)["text"]}
    if "n_chars" in docs.columns:
        same = F.col(s)["text"].eqNullSafe(F.col("text"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(F.col(s)["text"])).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).drop(s)
