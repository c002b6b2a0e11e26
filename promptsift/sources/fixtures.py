"""Synthetic logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def crash_line(i: Column) -> Column:
    """The i-th line of a crash loop; all are of one template."""
    micros = i * 37_000
    seconds = F.timestamp_seconds(F.lit(1768478400) + F.floor(micros / 1_000_000))
    fraction = F.when(micros % 1_000_000 == 0, F.lit("")).otherwise(F.format_string(".%06d", micros % 1_000_000))
    stamp = F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"), fraction)
    form = "%sZ payments[%d] ERROR connection refused: upstream postgres unreachable (req=%08x%08x) attempt=%d"
    return F.format_string(form, stamp, 1000 + i % 41, i, i * 31, i)


def crash_loop(spark: SparkSession, lines: int = 4000) -> DataFrame:
    """A log of one template: rows (i, line)."""
    return spark.range(lines).select(F.col("id").alias("i"), crash_line(F.col("id")).alias("line"))


def needle_log(spark: SparkSession) -> DataFrame:
    """Heartbeats, one fatal line, retries: rows (i, line)."""
    i = F.col("i")
    beat = F.format_string("2026-03-09T08:15:%02dZ ledger[%d] INFO heartbeat in time", i % 60, 400 + i)
    fatal = F.lit("2026-03-09T08:47:02Z ledger[77] FATAL write of segment refused: disk quota exceeded")
    retry = F.format_string("2026-03-09T08:48:%02dZ ledger[%d] DEBUG waits before the next attempt", i % 60, 5000 + i)
    return spark.range(4000).select(F.col("id").alias("i")).select("i", F.when(i < 1800, beat).when(i == 1800, fatal).otherwise(retry).alias("line"))


def pod_text(name: Column, restarts: Column) -> Column:
    """JSON of a pod whose state stands among long fields that a profile drops."""
    waiting = {"reason": "CrashLoopBackOff", "message": "the ledger's container was restarted too often"}
    pod = {
        "kind": "Pod",
        "apiVersion": "v1",
        "metadata": {"name": "%s", "uid": "0" * 36, "annotations": {f"note-{k}": "a" * 700 for k in range(5)}, "managedFields": [{"manager": "m", "fieldsV1": {"f:status": "b" * 2500}}]},
        "spec": {"containers": [{"name": "ledger", "image": "ledger:9"}]},
        "status": {"containerStatuses": [{"name": "ledger", "restartCount": "%d", "state": {"waiting": waiting}}]},
    }
    return F.format_string(json.dumps(pod, indent=2).replace('"%d"', "%d"), name, restarts)


def pod_json(spark: SparkSession, request_id: str) -> DataFrame:
    """One row (request_id, text): a pod."""
    return spark.range(1).select(F.lit(request_id).alias("request_id"), pod_text(F.lit("ledger-0"), F.lit(31)).alias("text"))


def as_text(lines: DataFrame, request_id: str, end: str = "") -> DataFrame:
    """One row (request_id, text) of rows (i, line)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(joined, F.lit(end)).alias("text")).select(F.lit(request_id).alias("request_id"), "text")
