"""Keyed randomness: every draw is a pure function of (tag, seed, key).

A draw never depends on row order, partitioning or retries, so a lost
executor recomputes exactly the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_BUCKET_DIGITS = 3  # 16**3 = 4096 order-preserving buckets over md5 text

# Multipliers and shifts of the 31-bit mixer; any odd values below 2**31 work,
# these are fixed so that the SQL used for checking draws the same numbers.
MIX_MASK = 2147483647
MIX_A = 739982445
MIX_B = 695872825
MIX_STEP = 1640531527


def tag_hash(tag: str, seed: int, *keys: Column | str) -> Column:
    """md5 text of ``tag:seed:key...``; sorting by it is a seeded shuffle."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(f"{tag}:{seed}"), *[c.cast("string") for c in cols]))


def hash_bucket(h: Column, digits: int = HEX_BUCKET_DIGITS) -> Column:
    """Order-preserving bucket of an md5 text."""
    return F.substring(h, 1, digits)


def hash_uint(h: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def uniform(tag: str, seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1) with 32 random bits."""
    return hash_uint(tag_hash(tag, seed, *keys)) / F.lit(4294967296.0)


def hash_int(tag: str, seed: int, bound: Column, *keys: Column | str) -> Column:
    """An integer in [0, bound)."""
    return F.pmod(hash_uint(tag_hash(tag, seed, *keys)), bound.cast("bigint"))


def id60(tag: str, seed: int, *keys: Column | str) -> Column:
    """A 60-bit row identity used to draw resampling weights."""
    return hash_uint(tag_hash(tag, seed, *keys), 15)
