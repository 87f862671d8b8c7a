"""Where rows lie in their files, so that numbers can travel without the texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.sources.staging import staged

PLACE = ["_file", "_file_too", "_row"]


def located(docs: DataFrame) -> DataFrame:
    """(row, _file, _file_too, _row): each row of ``docs`` as a struct, with 128 bits of its file and its number there.

    A table read from Parquet files and nothing else is located as it is: every later scan of it gives a row
    the same place. Anything else is written first. A place costs nothing but the scan.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if plain and "_metadata" not in docs.columns and "parquet" in docs._jdf.queryExecution().analyzed().toString():
        rows = docs.select(F.struct(*docs.columns).alias("row"), "_metadata")
    else:
        rows = staged(docs.select(F.struct("*").alias("row")), "located").select("row", "_metadata")
    path = F.col("_metadata.file_path")
    return rows.select(
        "row", F.xxhash64(path).alias("_file"), F.xxhash64(path, F.lit(1)).alias("_file_too"), F.col("_metadata.row_index").alias("_row")
    )
