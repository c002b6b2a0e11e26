"""Summarize: long texts become their most telling sentences, or a model's summary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from promptsift.functions.hooks import Llm, answered
from promptsift.functions.text import token_count
from promptsift.operators.sentences import summary
from promptsift.schema import RELEVANT, SUMMARIZED

MIN_TOKENS, KEEP_SHARE = 120, 0.4
KINDS = ("text", "log")


def extracted(texts: DataFrame, queries: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """request_id, pos, summary for the texts (request_id, pos, text) of two or more sentences."""
    asked = texts.select("request_id", "pos", "text").join(queries.select("request_id", "query"), "request_id", "left")
    found = asked.select("request_id", "pos", summary(F.col("text"), F.coalesce("query", F.lit("")), keep_share).alias("summary"))
    return found.filter(F.col("summary").isNotNull())


@arrow_udf(StringType())
def quoted(queries: pa.Array) -> pa.Array:
    """The query in quotes, as Python writes a string: what can't be printed, quotes and backslashes are escaped."""
    return pa.array([None if q is None else repr(q) for q in queries.to_pylist()], pa.string())


def prompt_for(query: Column, text: Column) -> Column:
    """What a model is asked. Fixed text."""
    lead = F.lit("Compress the following text to its bare-minimum relevant facts for the query: ")
    return F.concat(lead, quoted(query), F.lit(". Preserve numeric values, error codes, and identifiers verbatim.\n\n"), text)


def summarize(chunks: DataFrame, queries: DataFrame, min_tokens: int = MIN_TOKENS, keep_share: float = KEEP_SHARE, llm: Llm | None = None) -> DataFrame:
    """Long RELEVANT texts and logs, which become SUMMARIZED, inside their rows.

    A text of one sentence keeps its text; so does one for which a model has no answer, lest
    a failing model empties a prompt.
    """
    guard = (F.col("tier") == RELEVANT) & F.col("kind").isin(*KINDS) & (token_count(F.col("text")) >= min_tokens)
    long, query = F.when(guard, F.col("text")), F.coalesce("asked", F.lit(""))
    found = summary(long, query, keep_share) if llm is None else F.nullif(answered(llm)(prompt_for(query, long)), F.lit(""))
    out = chunks.join(queries.select("request_id", F.col("query").alias("asked")), "request_id", "left").withColumns({"long": guard, "summary": found})
    changed = {
        "text": F.when(F.col("long"), F.coalesce("summary", "text")).otherwise(F.col("text")),
        "tier": F.when(F.col("long"), SUMMARIZED).otherwise(F.col("tier")),
        "summarized": F.when(F.col("long"), F.lit(True)).otherwise(F.col("summarized")),
    }
    return out.withColumns(changed).select(*chunks.columns)
