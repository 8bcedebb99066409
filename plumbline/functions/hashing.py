"""Seeded hashes that place an identity in [0, 1) without any state.

``md5`` is used because it gives the same bits in every SQL engine. The first eight hex
digits are the unit value; hashes are compared as text, so no row pays for a hex parse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 2**32


def seeded_hash(seed: int | str, identity: Column) -> Column:
    """32 hex digits, a pure function of the seed and the identity."""
    return F.md5(F.concat(F.lit(f"{seed}|"), identity.cast("string")))


def unit_value(digest: Column) -> Column:
    """The hash as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(UNIT))


def below(digest: Column, fraction: float) -> Column:
    """``unit_value(digest) < fraction``, decided by a plain text comparison."""
    limit = math.ceil(fraction * UNIT)
    if limit >= UNIT:
        return F.lit(True)
    if limit <= 0:
        return F.lit(False)
    return digest < F.lit(f"{limit:08x}")


def divisible(digest: Column, divisor: int) -> Column:
    """True for one identity in ``divisor``."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(divisor)) == 0
