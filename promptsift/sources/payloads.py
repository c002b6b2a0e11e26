"""Tool payloads: one JSON object for each result of an agent's tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH_KEYS = ("path", "filename", "file", "target_file", "target")


def arguments(payload: Column) -> Column:
    """The tool's arguments as JSON text, whether they came as an object or as a string."""
    return F.get_json_object(payload, "$.toolArgs")


def file_path(args: Column) -> Column:
    return F.coalesce(*(F.get_json_object(args, f"$.{k}") for k in PATH_KEYS))


def is_broken(payload: Column) -> Column:
    """No JSON object, or one whose arguments are a text that isn't JSON."""
    whole = F.coalesce(F.get_json_object(payload, "$"), F.lit(""))
    args = arguments(payload)
    return ~whole.startswith("{") | (args.isNotNull() & (F.trim(args) != "") & F.get_json_object(args, "$").isNull())


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds tool, result_type, result, command and path."""
    p = F.col(column)
    args = arguments(p)
    fields = {"tool": "$.toolName", "result_type": "$.toolResult.resultType", "result": "$.toolResult.textResultForLlm"}
    out = {name: F.coalesce(F.get_json_object(p, at), F.lit("")) for name, at in fields.items()}
    return payloads.withColumns(out | {"command": F.coalesce(F.get_json_object(args, "$.command"), F.lit("")), "path": file_path(args)})
