"""Guards. A guard is a table of violations, empty when the data is good."""

from __future__ import annotations

from pyspark.sql import DataFrame


def guard(violations: DataFrame, fail: bool, message: str) -> DataFrame:
    """Return the violations, or raise with the first of them when ``fail`` is set."""
    if fail:
        found = violations.limit(5).collect()
        if found:
            raise ValueError(f"{message}: {[row.asDict(recursive=True) for row in found]}")
    return violations
