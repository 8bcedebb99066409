"""Text columns: whitespace strip and one spelling per real-world value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as whitespace when a label is stripped.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(column: Column | str) -> Column:
    """Trim all leading and trailing whitespace, not only spaces.

    Text that starts and ends with a printable ASCII character, as almost all does, is
    recognised by two code points and left alone.
    """
    text = _column(column)
    plain = [F.ascii(c).between(33, 126) for c in (text, F.substring(text, -1, 1))]
    return F.when(plain[0] & plain[1], text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def canonical_text(column: Column | str, dtype: T.DataType) -> Column:
    """Render a key column so that 80, 80.0 and ' 80 ' become the same text.

    NULL and NaN both become NULL.
    """
    value = _column(column)
    if isinstance(dtype, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(dtype, T.IntegralType):
        return value.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        wide = value.cast("double")
        whole = wide.try_cast("bigint")
        return (
            F.when(F.isnan(wide), F.lit(None).cast("string"))
            .when(wide == whole, whole.cast("string"))
            .otherwise(wide.cast("string"))
        )
    if isinstance(dtype, T.DecimalType):
        text = value.cast("string")
        return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)
    return strip(value.cast("string"))


def key_text(*columns: Column | str) -> Column:
    """Join key parts so that different tuples never give the same text.

    Each part carries its length, and NULL has a mark no value can produce.
    """
    parts = [
        F.coalesce(F.concat(F.length(_column(c)).cast("string"), F.lit(":"), _column(c)), F.lit("-"))
        for c in columns
    ]
    return F.concat_ws("|", *parts)


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
