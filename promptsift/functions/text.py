"""Text functions as Column expressions.

Patterns carry the flags that give the wanted semantics on the JVM: ``(?U)`` for Unicode
digits and word characters, ``(?d)`` so that only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and texts below are part of the results.
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
TIMESTAMP = r"(?U)\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
HEX_BLOB = r"(?U)\b[0-9a-fA-F]{8,}\b"
INTEGER = r"(?U)\b\d+\b"
SENTENCE_END = r"(?<=[.!?])(?U:\s)+(?=[A-Z])|\n+"
LOG_START = r"(?U)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|^\s*\[?\d{2}:\d{2}:\d{2}"
CODE_START = r"(?U)^\s*(```|def |class |#include |import |function )"
SPACE = r"(?U)[\s\x1c-\x1f]"


def token_count(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty or null text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))).cast("long")


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(text, r"\A" + "(?:" + SPACE + ")+", ""), "(?:" + SPACE + r")+\z", "")


def right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?:" + SPACE + r")+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def normalized(text: Column) -> Column:
    """Without terminal codes and carriage returns; blanks and blank lines in runs become one."""
    text = F.replace(F.regexp_replace(text, ANSI, ""), F.lit("\r"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?md)[ \t]+$", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def template_key(line: Column) -> Column:
    """A line with its timestamps, hexadecimal blobs and integers, in this order, made alike."""
    line = F.regexp_replace(line, TIMESTAMP, "<TS>")
    return F.regexp_replace(F.regexp_replace(line, HEX_BLOB, "<HEX>"), INTEGER, "<N>")


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def deduplicated_lines(text: Column) -> Column:
    """Each run of lines of one template as its first line, with the run's length if over 1.

    The whole text is handled inside its row: no shuffle, however long a log is.
    """
    lines = F.split(text, "\n", -1)

    def with_starts(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x["lines"]) - 1)
        first = F.filter(at, lambda i: (i == 0) | ~F.get(x["keys"], i).eqNullSafe(F.get(x["keys"], i - 1)))
        return F.struct(x["lines"].alias("lines"), first.alias("first"))

    def written(x: Column) -> Column:
        def run(j: Column) -> Column:
            start, stop = F.get(x["first"], j), F.coalesce(F.get(x["first"], j + 1), F.size(x["lines"]))
            line = F.get(x["lines"], start)
            return F.when(stop - start == 1, line).otherwise(F.concat(line, F.lit("   (x"), (stop - start).cast("string"), F.lit(")")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["first"]) - 1), run), "\n")

    keyed = _bound(lines, lambda l: F.struct(l.alias("lines"), F.transform(l, template_key).alias("keys")))
    return _bound(_bound(keyed, with_starts), written)


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


def judge_terms(text: Column) -> Column:
    """Distinct lower-case words of two or more characters."""
    return F.array_distinct(judge_words(text))


def judge_words(text: Column) -> Column:
    """The same with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]{2,})"), 1), F.lower)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def chunk_id(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 8))


def head_of(text: Column, source: Column, room: Column) -> Column:
    """The first ``room`` tokens of a text, and a note of what was cut."""
    omitted = token_count(text) - room
    note = F.concat(F.lit("\n\n[... +"), omitted.cast("string"), F.lit(" tokens truncated. Full source retrievable as "), chunk_id(source, text), F.lit(".]"))
    return F.concat(right_stripped(F.substring(text, F.lit(1), (room * 4).cast("int"))), note)


def kind_of(block: Column, parses: Column) -> Column:
    """json, log, code or text; parses tells whether the block is JSON."""
    opens = F.regexp_replace(block, r"\A(?:" + SPACE + ")+", "").rlike(r"\A[\{\[]")
    first = F.coalesce(F.get(F.filter(F.split(block, "\n", -1), lambda l: ~is_blank(l)), F.lit(0)), F.lit(""))
    return F.when(opens & parses, "json").when(first.rlike(LOG_START), "log").when(first.rlike(CODE_START), "code").otherwise("text")


def ratio(before: Column, after: Column) -> Column:
    """Saved share, 0 where there was nothing."""
    return F.when(before == 0, F.lit(0.0)).otherwise((before - after) / before)


def contains_all(text: Column, needles: list[str], ignore_case: bool = True) -> Column:
    """The must-contain grader."""
    found = F.lit(True)
    for needle in needles:
        found &= F.contains(F.lower(text), F.lit(needle.lower())) if ignore_case else F.contains(text, F.lit(needle))
    return found


def contains_each(text: Column, needles: Column) -> Column:
    """The same with the needles of a column, in any case."""
    return F.forall(needles, lambda n: F.contains(F.lower(text), F.lower(n)))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """The must-match grader."""
    return text.rlike(("(?i)" if ignore_case else "") + pattern)
