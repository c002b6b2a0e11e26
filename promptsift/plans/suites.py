"""The built-in evaluation: does what a question needs survive the funnel?"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsift.functions.hooks import hooks_from_env
from promptsift.functions.text import contains_each, token_count
from promptsift.operators import evals
from promptsift.plans import api
from promptsift.sources import fixtures

Judge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Case:
    """A question about a context; right answers hold all needles, in any case."""

    name: str
    query: str
    needles: tuple[str, ...]
    context: Callable[[SparkSession, str], DataFrame]
    options: api.Options


SUITES = {
    "tier1": (
        Case("crashloop-fatal", "What FATAL error occurred?", ("FATAL", "disk quota exceeded"), lambda spark, name: fixtures.as_text(fixtures.needle_log(spark), name), api.Options(max_tokens=1000)),
        Case("k8s-crashloop", "What is the waiting reason for the container?", ("CrashLoopBackOff",), fixtures.pod_json, api.Options(max_tokens=800, profile="k8s")),
    ),
}


def judge_from_env(env=None) -> Judge:
    """The model that the environment names where RUN_EVALS is 1 and there is one, else the mock judge."""
    env = os.environ if env is None else env
    llm = hooks_from_env(env)[1] if env.get("RUN_EVALS") == "1" else None
    return evals.answers if llm is None else api.judged_by(llm)


def results(spark: SparkSession, suite: str = "tier1", judge: Judge = evals.answers) -> DataFrame:
    """Per case: what evals.compared gives."""
    cases = SUITES[suite]
    asked = spark.createDataFrame([(c.name, c.query, list(c.needles)) for c in cases], "case_id string, query string, needles array<string>")
    texts = [c.context(spark, c.name) for c in cases]
    prompts = [api.reduce_alike(text, c.query, c.options) for c, text in zip(cases, texts)]
    raw, after = (reduce(DataFrame.unionByName, found).select(F.col("request_id").alias("case_id"), F.col(column).alias("context")) for found, column in ((texts, "text"), (prompts, "prompt")))
    sizes = asked.join(raw.select("case_id", token_count(F.col("context")).alias("raw_tokens")), "case_id").join(after.select("case_id", token_count(F.col("context")).alias("funneled_tokens")), "case_id", "left")
    queries = asked.select("case_id", "query")
    return evals.compared(sizes, judge(raw.join(queries, "case_id")), judge(after.join(queries, "case_id")), contains_each(F.col("answer"), F.col("needles")))
