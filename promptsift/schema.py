"""The rows that flow through a funnel.

A chunk is a piece of a request's context. ``pos`` is its place in the request's input;
``seq`` numbers the copies that the budget stage adds behind the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL, RELEVANT, SUMMARIZED, DEFERRED = range(4)
TIERS = ("CRITICAL", "RELEVANT", "SUMMARIZED", "DEFERRED")
KEY = ("request_id", "pos")

#: Optional columns of a chunk and the values of those that are missing.
ANNOTATIONS = {
    "severity": "string",
    "relevance": "double",
    "summarized": "boolean",
    "truncated": "boolean",
    "original_tokens": "long",
    "kept_tokens": "long",
    "critical_overflow": "boolean",
    "seq": "long",
    "profile": "string",
}


def as_chunks(df: DataFrame) -> DataFrame:
    """df with every column of a chunk; needs request_id, pos and text."""
    plain = {"kind": F.lit("text"), "source": F.lit("unknown"), "tier": F.lit(RELEVANT)}
    out = df.withColumns({c: v for c, v in plain.items() if c not in df.columns})
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in ANNOTATIONS.items() if c not in df.columns})
    own = {"request_id": F.col("request_id").cast("string"), "pos": F.col("pos").cast("long"), "text": F.coalesce("text", F.lit("")), "tier": F.col("tier").cast("int")}
    return out.withColumns(own).select("request_id", "pos", "text", "kind", "source", "tier", *ANNOTATIONS)


def is_live() -> Column:
    return F.col("tier") < DEFERRED


def order_keys() -> list[Column]:
    """The order of a request's rows: in place, then the added copies."""
    return [F.coalesce(F.col("seq"), F.lit(-1)), F.col("pos")]
