"""Severity of failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity by error type; any other type is "low".
SEVERITIES = {
    "critical": ("AuthenticationError", "InvalidConfigError"),
    "high": ("TimeoutError", "RateLimitError"),
    "medium": ("ConnectionError", "ValueError"),
}


def error_severity(error_type: Column) -> Column:
    severity = F.when(F.lit(False), "low")
    for name, types in SEVERITIES.items():
        severity = severity.when(error_type.isin(*types), name)
    return severity.otherwise("low")
