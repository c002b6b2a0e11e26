"""Relevance: the best chunks of each request stay, the others are deferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsift.functions.hooks import Embedder, embedded
from promptsift.functions.vectors import cosine
from promptsift.operators.ranking import query_scores
from promptsift.schema import DEFERRED, KEY, RELEVANT
from promptsift.shared import saved

#: Digits of a score that count for the order, so that no order of summation decides it.
DIGITS = 9


def best(scored: DataFrame, keep: int) -> DataFrame:
    """request_id, pos of each request's best, of rows (request_id, pos, score).

    Spark limits a rank that is compared with a number before it shuffles, so that a request
    brings no more than ``keep`` rows of each task together.
    """
    order = Window.partitionBy("request_id").orderBy(F.round("score", DIGITS).desc(), "pos")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("request_id", "pos")


def ranked(scored: DataFrame, keep: int) -> DataFrame:
    """Of rows (request_id, pos, score): adds kept."""
    return scored.join(best(scored, keep).withColumn("kept", F.lit(True)), list(KEY), "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def relevance(chunks: DataFrame, queries: DataFrame, keep: int = 5, embedder: Embedder | None = None) -> DataFrame:
    """Scores the RELEVANT chunks of requests with more than keep of them; queries: request_id, query.

    Ties go to earlier chunks. Requests with fewer candidates are left as they are, and their
    texts never taken apart. Only (request_id, pos, score) rows are ranked.
    """
    candidates = chunks.filter(F.col("tier") == RELEVANT).select("request_id", "pos", "text")
    crowded = candidates.groupBy("request_id").count().filter(F.col("count") > keep).select("request_id")
    candidates = candidates.join(crowded, "request_id", "left_semi")
    asked = queries.select("request_id", "query")
    if embedder is None:
        scored = query_scores(candidates, asked, ["request_id"])
    else:
        embed = embedded(embedder)
        own = candidates.select("request_id", "pos", embed("text").alias("a"))
        theirs = asked.join(crowded, "request_id", "left_semi").select("request_id", embed("query").alias("b"))
        scored = saved(own.join(theirs, "request_id").select("request_id", "pos", cosine(F.col("a"), F.col("b")).alias("score")))
    out = chunks.join(ranked(scored, keep), list(KEY), "left")
    changed = {"relevance": F.coalesce("score", "relevance"), "tier": F.when(~F.coalesce("kept", F.lit(True)), DEFERRED).otherwise(F.col("tier"))}
    return out.withColumns(changed).select(*chunks.columns)
