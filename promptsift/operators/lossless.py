"""Stages that lose nothing a reader needs: normalize, dedup, prune. None of them shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.functions import json_text, text
from promptsift.schema import is_live


def normalize(chunks: DataFrame) -> DataFrame:
    """All chunks, whatever their kind and tier."""
    return chunks.withColumn("text", text.normalized(F.col("text")))


def dedup(chunks: DataFrame) -> DataFrame:
    """Runs of lines of one template in live logs."""
    guard = is_live() & (F.col("kind") == "log")
    return chunks.withColumn("text", F.when(guard, text.deduplicated_lines(F.col("text"))).otherwise(F.col("text")))


def prune(chunks: DataFrame, denied: Iterable[str] = (), max_array: int = json_text.MAX_ARRAY, profiles: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Denied keys and the ends of long arrays in live JSON; with profiles, a chunk that names one has its keys denied instead."""
    guard = is_live() & (F.col("kind") == "json")
    text = F.when(guard, F.col("text"))
    cut = json_text.pruned(denied, max_array)(text) if profiles is None else json_text.pruned_by_profile(profiles, denied, max_array)(text, F.col("profile"))
    return chunks.withColumn("text", F.coalesce(cut, F.col("text")))
