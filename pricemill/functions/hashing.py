"""Seeded hashes: the same value for a key on any partitioning, on every run and in other SQL engines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemill.schema import PRICE_HIGH, PRICE_LOW


def seeded_digest(seed, *keys: str | Column) -> Column:
    """Hex md5 of ``seed:key`` for one key, else of ``seed`` and ``:length:key`` of every key.

    Lengths tell ('a:b', 'c') from ('a', 'b:c'). A null among several keys is ``:-``; one null key alone
    gives the digest of the seed.
    """
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    if len(texts) == 1:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))
    parts = [F.coalesce(F.concat(F.lit(":"), F.length(t).cast("string"), F.lit(":"), t), F.lit(":-")) for t in texts]
    return F.md5(F.concat(F.lit(str(seed)), *parts))


def unit_hash(seed, *keys: str | Column) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of the digest."""
    bits = F.conv(F.substring(seeded_digest(seed, *keys), 1, 8), 16, 10)
    return bits.cast("double") / F.lit(4294967296.0)


def hash_price(
    seed, *keys: str | Column, low: float = PRICE_LOW, high: float = PRICE_HIGH
) -> Column:
    """Uniform price in [low, high], two decimals, fixed by seed and key."""
    return F.round(F.lit(low) + F.lit(high - low) * unit_hash(seed, *keys), 2)
