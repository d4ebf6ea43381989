"""Repeatable pseudo-random numbers from row keys, independent of partitioning.

``md5`` is used because every SQL engine computes the same digest, so a draw can be checked elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 15
HASH_SPAN = float(16**HASH_DIGITS)


def digest(seed: int | str, key: Column) -> Column:
    """Hex digest of ``seed:key``; its order is a random permutation of the keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(seed: int | str, key: Column) -> Column:
    """Integer in [0, 16^15) from the first digits of the digest."""
    return F.conv(F.substring(digest(seed, key), 1, HASH_DIGITS), 16, 10).cast("bigint")


def hash_unit(seed: int | str, key: Column) -> Column:
    """Double in [0, 1)."""
    return hash_number(seed, key).cast("double") / F.lit(HASH_SPAN)
