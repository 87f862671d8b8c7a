"""Chunk folders and file listings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.sources.csv import csv_columns, csv_writer, read_csv


def write_chunks(
    chunked: DataFrame,
    path: str,
    file_format: str = "csv",
    mode: str = "errorifexists",
    one_file: bool = True,
) -> None:
    """Write ``path/chunk=k/``: one file per chunk, rows in index order, index not written.

    A reader that filters on ``chunk`` opens that folder only. One file means that all rows are shuffled
    by chunk and that one task writes each chunk. For chunks too large for a task, ``one_file=False``
    skips the shuffle: the sorted ranges behind the index are written where they are, so a chunk has as
    many files as it has ranges, each in index order.
    """
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"file_format must be csv or parquet, not {file_format!r}")
    rows = chunked if file_format == "parquet" else csv_columns(chunked)
    if one_file:
        rows = rows.repartition("chunk")
    rows = rows.sortWithinPartitions("chunk", "idx").drop("idx")
    writer = rows.write.mode(mode) if file_format == "parquet" else csv_writer(rows, mode)
    writer.partitionBy("chunk").format(file_format).save(path)


def read_chunks(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "csv", **options
) -> DataFrame:
    """Read what ``write_chunks`` wrote, with the ``chunk`` number of each row."""
    full = T.StructType([*schema.fields, T.StructField("chunk", T.LongType())])
    if file_format == "parquet":
        return spark.read.schema(full).parquet(path)
    return read_csv(spark, path, full, from_folders=("chunk",), **options)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name and size of each file in a folder; the contents are not read.

    Names starting with '_' or '.' are left out and a missing folder raises.
    """
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.col("length").alias("n_bytes"))
