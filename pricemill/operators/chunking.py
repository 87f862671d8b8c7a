"""Consecutive row numbers and fixed-size chunks, without sorting the table in one task."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.schema import CHUNK_ROWS
from pricemill.sources.csv import FILE_ORDER, read_csv
from pricemill.sources.staging import staged


def _row_in_partition():
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def row_index(
    df: DataFrame,
    order_by: str | list[str],
    n_ranges: int | None = None,
    spread_copies: bool = True,
) -> DataFrame:
    """Add ``idx``: 0, 1, 2, ... along ``order_by``, the same on any partitioning.

    Rows with equal keys follow a hash of their other columns, and whole copies of a row their place in a
    local sort, so rows that share a key or everything are spread over ranges as well. ``n_ranges`` is the
    number of sorted ranges, that of the shuffle by default; a range should fit an executor. Without
    ``spread_copies`` the local sort is left out and the copies of a row share a range.

    One range shuffle sorts the rows into ranges. Range number and offset are written with the rows, so
    both later uses (range sizes, rows) see one and the same layout even if executors are lost. Only the
    range sizes are summed up in order and joined back: they take 16 bytes per range (about 20 MB as a
    hash table for a million ranges, which at 128 MB each hold 128 TB), so they are always broadcast and
    the written rows are never shuffled again. The written table stays until it is removed, as described
    in ``released_after``.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    others = [F.col(f"`{name}`") for name in df.columns if name not in keys]
    order = [*keys, F.xxhash64(*others)] if others else keys
    if spread_copies:
        # Positions after a local sort: a repeated task gives the copies of a row the same numbers.
        df = df.sortWithinPartitions(*order).withColumn("_copy", _row_in_partition())
        order = [*order, "_copy"]
    by_range = df.repartitionByRange(n_ranges, *order) if n_ranges else df.repartitionByRange(*order)
    ranges = (
        by_range.sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_offset", _row_in_partition())
        .drop("_copy")
    )
    ranges = staged(ranges, "row-index")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        ranges.join(F.broadcast(starts), "_range")
        .withColumn("idx", F.col("_start") + F.col("_offset"))
        .drop("_range", "_offset", "_start")
    )


def _by_number(path):
    """Sort key of a path: its runs of digits compare as numbers."""
    digits = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(0))

    def part(text):
        number = F.ltrim(text, F.lit("0"))
        length = F.lpad(F.length(number).cast("string"), 4, "0")
        return F.when(text.rlike(r"^\d"), F.concat(length, number)).otherwise(text)

    return F.array_join(F.transform(digits, part), "")


def read_indexed_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """The rows of ``read_csv`` with their position ``idx`` in the files, from 0.

    Files follow each other by name, numbers in names compared as numbers. Rows of one file block already
    stand in order, so nothing is sorted or shuffled: the rows are written once with the number of their
    block, block sizes are summed up in file order and joined back. A block is a 64-bit hash of file and
    offset; two blocks with one hash fail the job. The sizes take 16 bytes per block (about 20 MB as a hash
    table for 800,000 blocks, which at 128 MB each hold 100 TB) and are always broadcast.

    The index is built in the read itself: on rows that were filtered before it could not be told.
    """
    rows = read_csv(spark, path, schema, file_order=True, **options)
    block = F.xxhash64("source_file", "source_block")
    rows = staged(rows.withColumn("_block", block), "file-row-index")
    sizes = rows.groupBy("_block").agg(
        F.count("*").alias("_rows"),
        F.min("source_row").alias("_first"),
        F.min("source_file").alias("_file"),
        F.max("source_file").alias("_other_file"),
        F.min("source_block").alias("_at"),
        F.max("source_block").alias("_other_at"),
    )
    before = Window.orderBy(_by_number(F.col("_file")), "_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    one = (F.col("_file") == F.col("_other_file")) & (F.col("_at") == F.col("_other_at"))
    start = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    starts = sizes.select(
        "_block",
        F.when(one, start).otherwise(F.raise_error(F.lit("two blocks share a hash"))).alias("_start"),
    )
    return (
        rows.join(F.broadcast(starts), "_block")
        .withColumn("idx", F.col("_start") + F.col("source_row"))
        .drop(*FILE_ORDER, "_block", "_start")
    )


def with_chunk(indexed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk`` to rows that have ``idx``: blocks of ``chunk_rows``, from 1; the last may be short."""
    if chunk_rows < 1:
        raise ValueError(f"chunk_rows must be at least 1, not {chunk_rows}")
    return indexed.withColumn("chunk", F.expr(f"idx div {int(chunk_rows)} + 1"))


def assign_chunks(
    df: DataFrame,
    order_by: str | list[str],
    chunk_rows: int = CHUNK_ROWS,
    n_ranges: int | None = None,
    spread_copies: bool = True,
) -> DataFrame:
    """Add ``idx`` and ``chunk``: consecutive blocks of ``chunk_rows`` rows along ``order_by``."""
    return with_chunk(row_index(df, order_by, n_ranges, spread_copies), chunk_rows)


def chunk_counts(chunked: DataFrame) -> DataFrame:
    """Rows per chunk."""
    return chunked.groupBy("chunk").agg(F.count("*").alias("n_rows"))
