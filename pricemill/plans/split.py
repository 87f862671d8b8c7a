"""Number the rows of a product file, split it into chunks, draw a sample from the first chunk."""

from pyspark.sql import DataFrame, SparkSession

from pricemill.operators.chunking import chunk_counts, read_indexed_csv, with_chunk
from pricemill.operators.sampling import sample_exact
from pricemill.schema import CHUNK_ROWS, SAMPLE_ROWS, SAMPLE_SEED, TEST_SCHEMA, TRAIN_SCHEMA
from pricemill.sources.csv import read_products, write_csv
from pricemill.sources.files import read_chunks, write_chunks
from pricemill.sources.staging import released_after


def land_file(
    spark: SparkSession,
    products_path: str,
    output_path: str,
    priced: bool,
    mode: str = "errorifexists",
    **options,
) -> DataFrame:
    """Convert CSV to Parquet once, with the row's position as ``idx``; returns the written table.

    A CSV file with quoted newlines is read by one task, Parquet by as many as needed. ``with_chunk``
    on the result needs no shuffle. ``options`` are those of ``read_csv``, such as ``multi_line=False``.
    """
    with released_after(spark):
        rows = read_indexed_csv(spark, products_path, TRAIN_SCHEMA if priced else TEST_SCHEMA, **options)
        rows.write.mode(mode).parquet(output_path)
    return spark.read.schema(rows.schema).parquet(output_path)


def split_file(
    spark: SparkSession,
    products_path: str,
    output_path: str,
    priced: bool,
    chunk_rows: int = CHUNK_ROWS,
    mode: str = "errorifexists",
    one_file: bool = True,
    **options,
) -> DataFrame:
    """Write ``output_path/chunk=k/``; returns the rows per chunk, counted on the written output.

    ``one_file`` as in ``write_chunks``, ``options`` as in ``read_csv``.
    """
    schema = TRAIN_SCHEMA if priced else TEST_SCHEMA
    with released_after(spark):
        rows = with_chunk(read_indexed_csv(spark, products_path, schema, **options), chunk_rows)
        write_chunks(rows, output_path, mode=mode, one_file=one_file)
    return chunk_counts(read_chunks(spark, output_path, schema))


def sample_file(
    spark: SparkSession,
    chunks_path: str,
    output_path: str,
    priced: bool = True,
    chunk: int = 1,
    n: int = SAMPLE_ROWS,
    seed=SAMPLE_SEED,
    mode: str = "errorifexists",
) -> DataFrame:
    """Draw ``n`` rows from one chunk, opening no other, and write them; returns the written rows."""
    schema = TRAIN_SCHEMA if priced else TEST_SCHEMA
    rows = read_chunks(spark, chunks_path, schema).filter(f"chunk = {int(chunk)}").drop("chunk")
    write_csv(sample_exact(rows, n, "sample_id", seed), output_path, mode)
    return read_products(spark, output_path, priced)
