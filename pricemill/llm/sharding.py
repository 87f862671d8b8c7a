"""Jump consistent hashing of stable keys to shards."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.operators.chunking import row_index

# Multiplier of the 64-bit linear congruential generator of jump consistent hashing.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. From n to n + 1 shards a key stays or moves to shard n."""
    if shards < 1:
        raise ValueError(f"there must be at least 1 shard, not {shards}")
    keys = keys.astype(np.uint64)
    at = np.zeros(len(keys), np.int64)
    following = np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))
    while len(open_):
        at[open_] = following[open_]
        keys[open_] = keys[open_] * _MULTIPLIER + np.uint64(1)
        draw = (keys[open_] >> np.uint64(33)).astype(np.float64) + 1
        following[open_] = ((at[open_] + 1) * (2.0**31 / draw)).astype(np.int64)
        open_ = open_[following[open_] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key: its text is hashed to 64 bits, so neighbouring ids are independent. Null is a key."""

    @F.pandas_udf("int")
    def jumped(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jumped(F.xxhash64(key.cast("string")))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), one row per row of ``docs``.

    The id and the shard count alone decide the shard, so repeated ids share one. ``size`` is the bytes of
    the text plus 1 (null text: 1). ``slot`` counts the rows of a shard from 0 in order of the id, null
    first; whole copies of a row take neighbouring slots. ``grown_shard`` is the shard with one shard more.

    The texts never move: a few numbers per row are numbered by one range shuffle (``row_index``), and a
    shard's first position is a sum over one row per shard.
    """
    text, key = F.col(text_col), F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    )
    placed = row_index(rows, ["shard", "doc_id"])
    first = placed.groupBy("shard").agg(F.min("idx").alias("first"))
    # One row per shard, and their number is a parameter of the job.
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("idx") - F.col("first")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Write the rows as folders ``shard=0``, ``shard=1``, ... of Parquet, without a shuffle."""
    if "shard" in docs.columns:
        raise ValueError("the rows have a column shard already")
    docs.withColumn("shard", shard_of(F.col(id_col), shards)).write.partitionBy("shard").parquet(path)
