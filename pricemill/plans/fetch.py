"""Fetch the images of a product table, again and again until none is missing."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.operators.images import fetch_images, image_manifest, pending_images, store_for
from pricemill.schema import FETCH_SCHEMA, FETCH_TASKS, FETCH_THREADS

LOG_SCHEMA = T.StructType([*FETCH_SCHEMA.fields, T.StructField("round", T.IntegerType())])


def fetch(
    products: DataFrame,
    folder: str,
    status_path: str,
    fetcher: Callable[[str], bytes],
    store=None,
    n_tasks: int = FETCH_TASKS,
    threads: int = FETCH_THREADS,
    trust_log: bool = False,
) -> DataFrame:
    """One round: fetch what is not in the folder, append the outcome of every file to the status table.

    Tasks ask the store for every file of the manifest, so a file that was deleted, or that an earlier
    round put into another folder, is fetched. ``trust_log`` leaves out the paths that the status table
    lists as 'ok' without asking. Returns the files of this folder per status, each with its last outcome.
    """
    spark = products.sparkSession
    manifest = image_manifest(products, folder)
    pending, this_round = manifest, 1
    try:
        log = spark.read.schema(LOG_SCHEMA).parquet(status_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        this_round = (log.agg(F.max("round")).first()[0] or 0) + 1
        if trust_log:
            pending = pending_images(manifest, last_outcomes(log))
    outcome = fetch_images(pending, fetcher, store or store_for(folder), n_tasks, threads)
    outcome.withColumn("round", F.lit(this_round)).write.mode("append").parquet(status_path)
    log = spark.read.schema(LOG_SCHEMA).parquet(status_path)
    return fetch_summary(log.join(manifest.select("path"), "path", "left_semi"))


def last_outcomes(log: DataFrame) -> DataFrame:
    """``path, status`` of each file in the last round that names it."""
    return log.groupBy("path").agg(F.max_by("status", "round").alias("status"))


def fetch_summary(log: DataFrame) -> DataFrame:
    """Files per last status."""
    return last_outcomes(log).groupBy("status").agg(F.count("*").alias("n_files"))
