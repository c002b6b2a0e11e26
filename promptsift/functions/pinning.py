"""Which chunks must stay: severities, the query's own words, patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptsift.functions.text import is_blank
from promptsift.schema import CRITICAL, RELEVANT

#: Fixed values.
CRITICAL_SEVERITIES = ("FATAL", "ERROR", "CRIT", "CRITICAL")


def by_severity(severity: Column) -> Column:
    return F.upper(F.coalesce(severity, F.lit(""))).isin(*CRITICAL_SEVERITIES)


def by_query(text: Column, query: Column) -> Column:
    """The text holds the query as it stands, which isn't blank."""
    query = F.coalesce(query, F.lit(""))
    return ~is_blank(query) & F.contains(text, query)


def by_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """One of the patterns is found; what isn't a pattern is looked for as it stands."""
    found = F.lit(False)
    for pattern in patterns:
        try:
            re.compile(pattern)
            found |= text.rlike(pattern)
        except re.error:
            found |= F.contains(text, F.lit(pattern))
    return found


def pinned_tier(text: Column, severity: Column, query: Column, patterns: Sequence[str] = ()) -> Column:
    return F.when(by_severity(severity) | by_query(text, query) | by_patterns(text, patterns), CRITICAL).otherwise(RELEVANT)
