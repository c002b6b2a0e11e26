"""What callers use: reduce specs, texts or tool results to prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsift.functions import tools
from promptsift.functions.hooks import Embedder, Llm, tried
from promptsift.functions.text import is_blank, stripped, token_count
from promptsift.operators import budget as b
from promptsift.operators import store as st
from promptsift.plans.funnel import Funnel, default_funnel, lite_funnel
from promptsift.plans.profiles import profile
from promptsift.shared import saved
from promptsift.sources import payloads, texts
from promptsift.streaming import gate

SUMMARY_BUDGET = 200


@dataclass(frozen=True)
class Options:
    """What shapes a funnel."""

    max_tokens: int = b.MAX_TOKENS
    keep: int = 5
    profile: str = "passthrough"
    max_array: int = 10
    embedder: Embedder | None = None
    llm: Llm | None = None
    patterns: Sequence[str] = ()

    def full(self) -> Funnel:
        return default_funnel(self.max_tokens, self.keep, self.embedder, self.llm, profile(self.profile), self.max_array)

    def lite(self) -> Funnel:
        return lite_funnel(self.max_tokens, profile(self.profile), self.max_array)


@dataclass(frozen=True)
class Reduced:
    """prompts: a row for each request; store: with what was deferred; metrics: by request and stage."""

    prompts: DataFrame
    store: DataFrame
    metrics: DataFrame


def reduce_specs(specs: DataFrame, queries: DataFrame, options: Options = Options(), store: DataFrame | None = None, workspace_key: str = "", now: float | None = None) -> Reduced:
    """The full funnel over specs (request_id, pos, text and optionally kind, source, severity), pinned.

    queries: request_id, query. Severe chunks, those with the query's own words, and those
    that match a pattern stay whatever the budget.
    """
    asked = specs.join(queries.select("request_id", "query"), "request_id", "left")
    chunks = texts.ingested(asked, patterns=list(options.patterns))
    funnel = options.full()
    steps = funnel.steps(chunks, queries)
    kept = st.put(store, steps[-1], time.time() if now is None else now, workspace_key)
    prompts = saved(b.assemble(steps[-1]))
    return Reduced(prompts, kept, funnel.metrics_of(steps, prompts))


def reduce_texts(found: DataFrame, options: Options = Options()) -> DataFrame:
    """A prompt for each text (request_id, text, query): blank queries take the lite funnel, the others the full one."""
    chunks = saved(texts.blocks(found))
    queries = found.select("request_id", F.coalesce("query", F.lit("")).alias("query"))
    blank = queries.filter(is_blank(F.col("query"))).select("request_id")
    lite = options.lite().run(chunks.join(blank, "request_id", "left_semi"), queries)
    full = options.full().run(chunks.join(blank, "request_id", "left_anti"), queries)
    return lite.unionByName(full)


def reduce_alike(found: DataFrame, query: str = "", options: Options = Options()) -> DataFrame:
    """A prompt for each text (request_id, text and optionally profile), all asked the same; the lite funnel without a query."""
    queries = found.select("request_id", F.lit(query).alias("query"))
    return (options.full() if query.strip() else options.lite()).run(texts.blocks(found), queries)


def file_summaries(files: DataFrame) -> DataFrame:
    """path and summary of files (path, text): their lite reduction, null where it isn't worth showing."""
    sized = files.filter(F.length("text").between(*gate.FILE_CHARS)).select(F.col("path").alias("request_id"), "text")
    prompts = reduce_alike(sized, options=Options(max_tokens=SUMMARY_BUDGET, keep=3)).select(F.col("request_id").alias("path"), "prompt")
    out = files.select("path", F.length("text").alias("n")).join(prompts, "path", "left")
    return out.select("path", gate.worth_showing(F.col("n"), F.coalesce("prompt", F.lit(""))).alias("summary"))


def tool_results(results: DataFrame, options: Options = Options(), settings: gate.Settings = gate.Settings(), files: DataFrame | None = None, query: str = "", disabled: bool = False) -> DataFrame:
    """A decision on every tool result (event_id, session, at, payload), the text that replaces it, if any, and the hook's answer.

    Results that may be reduced go through the funnel with their command's profile: the lite
    one without a query. The gate then decides session by session. Rows of equal event_id are
    events of their own. A payload that can't be read is an unexpected error of its own row,
    whose answer is empty.
    """
    parsed = payloads.parsed(results.select("event_id", "session", "at", "payload"))
    by_command = F.when(F.col("tool").isin("bash", "shell", "powershell"), tools.profile_of(F.col("command"))).otherwise("passthrough")
    guard = tools.guard(F.col("tool"), F.col("result_type"), F.col("result"), settings.skipped, disabled, payloads.is_broken(F.col("payload")))
    parsed = saved(parsed.withColumns({"profile": by_command, "guard": guard, "row": F.monotonically_increasing_id().cast("string")}).drop("payload"))
    open_ = parsed.filter(F.col("guard") == "").select(F.col("row").alias("request_id"), F.col("result").alias("text"), "profile")
    reduced = reduce_alike(open_, query, options).select(F.col("request_id").alias("row"), "prompt")
    joined = parsed.join(reduced, "row", "left").withColumnRenamed("prompt", "cleaned_text")
    joined = joined.withColumn("summary", F.lit(None).cast("string")) if files is None else joined.join(file_summaries(files), "path", "left")
    # tokens as the gate counts them: a quarter of the characters
    quarter = lambda c: F.floor(F.length(c) / 4).cast("long")
    sizes = {"tokens": quarter("result"), "cleaned": quarter(F.nullif("cleaned_text", F.lit(""))), "shrinks": F.length("cleaned_text") < F.length("result")}
    events = saved(joined.withColumns(sizes))
    decisions = gate.decided(events.withColumn("event_id", F.col("row")), settings).select(F.col("event_id").alias("row"), "verdict", "reason", "total", "views", "nudged", "file")
    before = gate.injected(F.col("nudged"), F.col("views"), F.col("file"), F.col("path"), F.col("summary"))
    text = gate.notice(F.col("verdict"), F.col("tool"), F.col("profile"), F.col("tokens"), F.col("cleaned"), F.col("cleaned_text"), F.col("result"), before)
    both = decisions.join(events, "row").withColumn("replacement", text)
    return both.select("event_id", "session", "at", "tool", "tokens", "verdict", "reason", "total", "nudged", "file", "replacement", gate.answer(F.col("replacement")).alias("answer"))


def log_decisions(decisions: DataFrame, path: str, muted: str = "") -> None:
    """Appends the verdicts to a table, unless the setting mutes it."""
    if not tools.is_muted(muted):
        decisions.select("session", "at", "tool", "tokens", "verdict", "reason", "nudged", "file").write.mode("append").parquet(path)


def judged_by(llm: Llm) -> Callable[[DataFrame], DataFrame]:
    """A judge that asks a model: a function of contexts (case_id, context, query) that gives case_id, answer, error."""

    def run(contexts: DataFrame) -> DataFrame:
        prompt: Column = F.concat(F.lit("Answer the question using only the context below.\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer:"))
        return contexts.select("case_id", tried(llm)(prompt).alias("a")).select("case_id", stripped(F.col("a")["answer"]).alias("answer"), F.col("a")["error"].alias("error"))

    return run


def reduce_file(spark: SparkSession, path: str, query: str, options: Options) -> DataFrame:
    """A prompt for each file, which is read in splits; the lite funnel without a query."""
    chunks = saved(texts.read_blocks(spark, path))
    queries = chunks.select("request_id").distinct().withColumn("query", F.lit(query))
    return (options.full() if query.strip() else options.lite()).run(chunks, queries)


def sizes(prompts: DataFrame) -> DataFrame:
    return prompts.select("request_id", token_count(F.col("prompt")).alias("tokens"))
