"""Numeric cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def clean_float(column: Column) -> Column:
    """Float32 with every missing, unreadable or infinite value turned into NaN.

    Finiteness is checked after the narrowing cast, so a double too large for float32
    becomes NaN as well.
    """
    value = column.try_cast("double").cast("float")
    finite = value.isNotNull() & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(NAN).cast("float"))
