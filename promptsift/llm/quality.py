"""Quality rules by repetition coverage.

Words are the runs between white space. For each of several n-gram lengths, rolling hashes
over a text's words tell which n-grams occur twice or more in it; the characters of the words
inside such n-grams, each counted once, over the characters of all words are the coverage of
that length. Lines are treated likewise. A text is rejected if a coverage is over its limit.

Results for edge cases: a null text has no words, and a text of under ``MIN_WORDS`` words
fails the base rule. Repeated rows get equal results. Texts of any length are taken whole,
in memory of a small multiple of their own size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.llm.common import fresh, text_column

MIN_WORDS = 20
WINDOW = 8
#: Largest share of repeated windows' words, in percent, under the base rule.
MAX_REPEATED = 30
#: Most coverage that is kept, by n-gram length in words.
COVERAGE = {4: 0.35, 6: 0.30, 10: 0.25}
#: Most coverage by repeated lines.
LINE_COVERAGE = 0.30
#: Most symbols for each word: one for ten, as public heuristics for web text have it.
SYMBOLS = 0.1
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, coverage double, line_coverage double"

_SPACE = np.zeros(256, np.uint8)
_SPACE[[32, 9, 10, 11, 12, 13]] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
#: A character's bytes after its first.
_LATER = np.zeros(256, np.uint8)
_LATER[128:192] = 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each small integer."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n-gram: a polynomial over its words' hashes, modulo 2 to the 64."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out *= _BASE
        out += hashes[k : k + len(out)]
    return out


def repeated(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that occurs twice or more."""
    size = len(hashes)
    if size <= n:
        return np.zeros(size, bool)
    grams = rolling(hashes, n)
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(size, bool)
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _points(word: bytes) -> int:
    """A word's code points."""
    return len(word) if word.isascii() else len(word.decode("utf-8", "surrogatepass"))


def measure(text: str | None) -> tuple:
    """The values of COLUMNS for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    raw = np.frombuffer(data, np.uint8)
    chars = int(len(raw) - _LATER[raw].sum(dtype=np.int64) - _SPACE[raw].sum(dtype=np.int64))
    symbols = int(_SYMBOL[raw].sum(dtype=np.int64))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(_points, line.split()))
        elif line and not line.isspace():
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    worst, n_repeat = 0.0, 0
    line_cover = dup_chars / max(1, chars)
    if len(number) < n:
        hashes = _mixed(ids)
        lengths = np.fromiter(map(len if data.isascii() else _points, number), np.int64, len(number))[ids]
        n_repeat = int(repeated(hashes, WINDOW).sum())
        for size, most in COVERAGE.items():
            worst = max(worst, int(lengths[repeated(hashes, size)].sum()) / chars / most)
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * n
    kept = not failed and worst <= 1 and line_cover <= LINE_COVERAGE and symbols <= SYMBOLS * n
    return n, chars, symbols, dup_lines, n_repeat, failed, kept, worst, line_cover


def quality_column():
    """A column function: text to a struct of COLUMNS."""
    return text_column(lambda texts: [measure(t) for t in texts], COLUMNS)


def judged(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and COLUMNS; coverage is the largest share of its limit."""
    return docs.select("doc_id", quality_column()(F.col("text")).alias("q")).select("doc_id", "q.*")


def kept_only(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    q = fresh(docs, "quality")
    return docs.withColumn(q, quality_column()(F.col("text"))).filter(F.col(q)["kept"]).drop(q)
