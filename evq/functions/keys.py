"""Hash of a row key: seeded, independent of partitioning and row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq import config

SPAN = 2**32


def hash_digits(key: Column | str, seed: int | str = config.RANDOM_STATE) -> Column:
    """First 8 hex digits of ``md5(seed:key)``. Their string order is their order as numbers."""
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)


def hash_unit(key: Column | str, seed: int | str = config.RANDOM_STATE) -> Column:
    """The digits as a uniform integer in [0, 2^32)."""
    return F.conv(hash_digits(key, seed), 16, 10).cast("long")


def in_fraction(key: Column | str, fraction: float, seed: int | str = config.RANDOM_STATE) -> Column:
    """True for about ``fraction`` of the keys."""
    limit = int(round(fraction * SPAN))
    if limit >= SPAN:
        return F.lit(True)
    return hash_digits(key, seed) < F.lit(f"{limit:08x}")
