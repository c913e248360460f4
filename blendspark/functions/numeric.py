"""Small numeric and hashing helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Six decimals, and no negative zero.  The noise of sums taken in another order
    is rounded away first, so that it cannot tip a value that lies on an edge."""
    return F.when(F.abs(value) < 5e-7, F.lit(0.0)).otherwise(F.round(F.round(value, 10), 6))


def hash_key(seed: int | str, *parts: Column) -> Column:
    """Hex digest that orders rows at random but the same way every time."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def hash_unit(seed: int | str, *parts: Column) -> Column:
    """Number in [0, 1) from the first 12 hex digits of ``hash_key``."""
    digits = F.conv(F.substring(hash_key(seed, *parts), 1, 12), 16, 10)
    return digits.cast("double") / float(16**12)
