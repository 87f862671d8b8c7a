"""Exact, reproducible samples: the n rows with the smallest seeded key hash."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.functions.hashing import seeded_digest
from pricemill.operators.chunking import row_index
from pricemill.schema import SAMPLE_ROWS, SAMPLE_SEED

# Hex digits of the hash counted per pass; a pass groups by at most 16**4 new values.
_DIGITS = (4, 8, 12, 16, 20, 24, 28, 32)


def _too_many(n: int, total: int) -> ValueError:
    return ValueError(f"cannot sample {n} rows out of {total} without replacement")


def _cutoff(df: DataFrame, n: int, digest: Column) -> tuple[str, int, bool]:
    """A prefix of hashes up to which n rows are reached, the rows below it, and whether it ends at n.

    Counts rows per hash prefix, and again inside the prefix that holds the n-th hash, until a prefix ends
    at exactly n rows or is a whole hash. Reads the key alone; one row per pass reaches the driver.
    """
    hashes = df.select(digest.alias("digest"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix, below = "", 0
    for digits in _DIGITS:
        inside = hashes.filter(F.col("digest").startswith(prefix)) if prefix else hashes
        counts = (
            inside.groupBy(F.substring("digest", 1, digits).alias("bucket"))
            .agg(F.count("*").alias("rows"))
            .withColumn("upto", F.sum("rows").over(running))
        )
        reached = F.when(F.col("upto") + below >= n, F.col("bucket"))
        hit = counts.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
            F.min_by(F.struct("bucket", "rows", "upto"), reached).alias("first"),
        ).first()
        if hit.first is None:
            raise _too_many(n, hit.total)
        prefix = hit.first.bucket
        below += hit.first.upto - hit.first.rows
        if below + hit.first.rows == n:
            return prefix, below, True
    return prefix, below, False


def _sample_digest(n: int, key: str | list[str], seed) -> Column:
    if n < 0:
        raise ValueError(f"cannot sample {n} rows")
    return seeded_digest(seed, *([key] if isinstance(key, str) else key))


def in_sample(
    df: DataFrame, n: int = SAMPLE_ROWS, key: str | list[str] = "sample_id", seed=SAMPLE_SEED
) -> Column:
    """Condition on ``key`` that is true for exactly ``n`` rows of ``df``; ``key`` must be unique.

    The sample is every row up to a cut-off in hash order. The condition itself needs no join, sort or
    shuffle, and can be put on any table that has the key.
    """
    digest = _sample_digest(n, key, seed)
    if n == 0:
        return F.lit(False)
    cutoff, _, exact = _cutoff(df, n, digest)
    if not exact:
        raise ValueError(f"{key!r} has copies at row {n} of the sample order: it must be unique")
    return F.substring(digest, 1, len(cutoff)) <= cutoff


def sample_exact(
    df: DataFrame, n: int = SAMPLE_ROWS, key: str | list[str] = "sample_id", seed=SAMPLE_SEED
) -> DataFrame:
    """Exactly ``n`` rows without replacement; ``n`` above the row count raises.

    A filter on the scan, as in ``in_sample``. If copies of one key lie across the cut-off, those needed
    are taken in the order of ``row_index``.
    """
    digest = _sample_digest(n, key, seed)
    if n == 0:
        return df.filter(F.lit(False))
    cutoff, below, exact = _cutoff(df, n, digest)
    if exact:
        return df.filter(F.substring(digest, 1, len(cutoff)) <= cutoff)
    copies = row_index(df.filter(digest == cutoff), key)
    needed = copies.filter(F.col("idx") < n - below).drop("idx")
    return df.filter(digest < cutoff).unionByName(needed)
