"""Evaluation: does the answer survive the reduction?

A question's best lines and their neighbours are the mock judge's answer, found inside the
context's row. Everything runs for many cases at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsift.functions.text import judge_terms, judge_words, stripped

TOP, NEAR, FALLBACK_CHARS = 3, 2, 400
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines_of(contexts: DataFrame) -> DataFrame:
    """case_id, idx, line of contexts (case_id, context); an end of line ends the last line, too."""
    text = F.regexp_replace("context", "(?:" + LINE_END + r")\z", "")
    return contexts.filter(F.length("context") > 0).select("case_id", F.posexplode(F.split(text, LINE_END, -1)).alias("idx", "line"))


def best_lines(contexts: DataFrame, top: int = TOP) -> DataFrame:
    """Of contexts (case_id, context, query): the lines with most of the query's words; earlier lines first."""
    asked = contexts.select("case_id", judge_terms(F.col("query")).alias("asked"))
    scored = lines_of(contexts).join(asked, "case_id").select("case_id", "idx", "line", F.size(F.array_intersect("asked", judge_terms(F.col("line")))).alias("score"))
    order = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "idx")
    return scored.filter("score > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def answers(contexts: DataFrame, top: int = TOP, near: int = NEAR) -> DataFrame:
    """case_id, answer."""
    text = F.regexp_replace("context", "(?:" + LINE_END + r")\z", "")
    asked = judge_terms(F.col("query"))
    # inside the row: no line leaves it
    lines = contexts.select("case_id", "context", asked.alias("asked"), F.when(F.length("context") > 0, F.split(text, LINE_END, -1)).alias("lines"))
    scores = F.transform("lines", lambda line, i: F.struct((-F.size(F.array_intersect("asked", judge_words(line)))).alias("score"), i.alias("idx")))
    hits = F.slice(F.array_sort(F.filter(scores, lambda x: x["score"] < 0)), 1, top)
    chosen = lines.withColumn("near", F.flatten(F.transform(hits, lambda x: F.sequence(x["idx"] - near, x["idx"] + near))))
    found = F.filter(F.transform(F.filter(F.array_sort(F.array_distinct("near")), lambda i: (i >= 0) & (i < F.size("lines"))), lambda i: stripped(F.get("lines", i))), lambda line: line != "")
    first = F.get(F.filter("lines", lambda line: stripped(line) != ""), F.lit(0))
    none = (F.size("asked") == 0) | (F.coalesce(F.length("context"), F.lit(0)) == 0)
    answer = F.when(none, F.substring("context", 1, FALLBACK_CHARS)).when(F.size("near") > 0, F.array_join(found, "\n")).otherwise(F.coalesce(stripped(first), F.lit("")))
    return chosen.select("case_id", answer.alias("answer"))


def answers_of_lines(lines: DataFrame, queries: DataFrame, top: int = TOP, near: int = NEAR) -> DataFrame:
    """case_id, answer for contexts of any length, whose lines are rows (case_id, idx from 0, line).

    queries: case_id, query. Lines are scored where they are, each task sends a case's best,
    and only their neighbours and the first lines are gathered. Equal to ``answers`` of the
    lines' text. A case without lines has the answer of an empty context.
    """
    asked = queries.select("case_id", judge_terms(F.col("query")).alias("asked"))
    own = lines.select("case_id", F.col("idx").cast("long").alias("idx"), "line")
    scored = own.join(asked, "case_id").select("case_id", "idx", F.size(F.array_intersect("asked", judge_terms(F.col("line")))).alias("score")).filter("score > 0")
    order = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "idx")
    hits = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    around = hits.select("case_id", F.explode(F.sequence(F.col("idx") - near, F.col("idx") + near)).alias("idx")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"])
    found = own.join(around, ["case_id", "idx"]).select("case_id", "idx", stripped(F.col("line")).alias("line"))
    close = found.groupBy("case_id").agg(F.array_join(F.filter(ordered, lambda x: x != ""), "\n").alias("close"))
    filled = own.filter(stripped(F.col("line")) != "").groupBy("case_id").agg(F.min("idx").alias("idx"))
    first = own.join(filled, ["case_id", "idx"]).select("case_id", stripped(F.col("line")).alias("first"))
    # each line takes a character at least, its end
    start = own.filter(F.col("idx") < FALLBACK_CHARS).select("case_id", "idx", F.substring("line", 1, FALLBACK_CHARS).alias("line"))
    head = start.groupBy("case_id").agg(F.substring(F.array_join(ordered, "\n"), 1, FALLBACK_CHARS).alias("head"))
    every = asked.join(close, "case_id", "left").join(first, "case_id", "left").join(head, "case_id", "left")
    answer = F.when(F.size("asked") == 0, F.col("head")).otherwise(F.coalesce("close", "first"))
    return every.select("case_id", F.coalesce(answer, F.lit("")).alias("answer"))


def compared(cases: DataFrame, raw: DataFrame, funneled: DataFrame, grader: Column) -> DataFrame:
    """Per case: tokens, whether each answer is right, compression, delta, error.

    cases: case_id, raw_tokens, funneled_tokens and what the grader looks at besides the column
    answer; raw and funneled: case_id, answer and optionally error. A case without an answer of
    a judge, or without a prompt, is wrong there, says why, and doesn't stop the others. Where
    the raw answer or the prompt is missing, the tokens count as not reduced.
    """

    def side(answers: DataFrame, name: str) -> DataFrame:
        error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
        return answers.select("case_id", F.col("answer").alias(f"{name}_answer"), error.alias(f"{name}_error"))

    def right(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_correct"), F.lit(False))

    both = cases.join(side(raw, "raw"), "case_id", "left").join(side(funneled, "funneled"), "case_id", "left")
    for name in ("raw", "funneled"):
        both = both.withColumn("answer", F.col(f"{name}_answer")).withColumn(f"{name}_correct", grader).drop("answer")
    no_raw, no_prompt = F.col("raw_error").isNotNull(), F.col("funneled_tokens").isNull()
    error = F.when(no_raw, F.concat(F.lit("raw judge failed: "), "raw_error")).when(no_prompt, "funnel produced no assembled chunk").when(F.col("funneled_error").isNotNull(), F.concat(F.lit("funneled judge failed: "), "funneled_error"))
    both = both.withColumns({
        "funneled_tokens": F.when(no_raw | no_prompt, F.col("raw_tokens")).otherwise(F.col("funneled_tokens")),
        "raw_correct": right("raw"),
        "funneled_correct": right("funneled") & ~no_raw,
        "error": error,
    })
    squeezed = F.when(F.col("raw_tokens") == 0, F.lit(0.0)).otherwise(1 - F.col("funneled_tokens") / F.col("raw_tokens"))
    delta = F.col("funneled_correct").cast("int") - F.col("raw_correct").cast("int")
    return both.withColumns({"compression": squeezed, "delta": delta}).drop("raw_error", "funneled_error")


def suite(results: DataFrame) -> DataFrame:
    """One row: cases, right answers before and after, regressions."""
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("raw_correct").alias("raw_correct"), F.count_if("funneled_correct").alias("funneled_correct"), F.count_if(F.col("delta") < 0).alias("regressions"))


#: The table's columns and their widths; the first is set left.
REPORT = (("CASE", 24), ("COMPRESSION", 11), ("RAW", 4), ("FUNNELED", 8), ("DELTA", 0))


def report(results: DataFrame) -> str:
    """The fixed-width table of a suite; a suite is small, so its rows come to the driver."""
    rows = results.orderBy("case_id").collect()
    if not rows:
        return "(no eval cases)"

    def line(*cells: str) -> str:
        return "  ".join(c.rjust(w) if k else c.ljust(w) for k, (c, (_, w)) in enumerate(zip(cells, REPORT)))

    said = ("FAIL", "OK")
    head = line(*(name for name, _ in REPORT))
    body = [line(r.case_id, f"{r.compression:.1%}", said[r.raw_correct], said[r.funneled_correct], "=+-"[r.delta]) + (f"  ({r.error})" if r.error else "") for r in rows]
    totals = {"raw accuracy": sum(r.raw_correct for r in rows), "funneled accuracy": sum(r.funneled_correct for r in rows)}
    ends = [f"{k}: {v}/{len(rows)}" for k, v in totals.items()] + [f"regressions: {sum(r.delta < 0 for r in rows)}"]
    return "\n".join([head, "-" * len(head), *body, "", "   ".join(ends)])
