"""Predict every product of a file and write the submission."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.operators.predict import Predictor, predict
from pricemill.sources.csv import read_products, read_submission, write_csv


def predict_file(
    spark: SparkSession,
    products_path: str,
    output_path: str,
    predictor: Predictor | None = None,
    mode: str = "errorifexists",
    **options,
) -> DataFrame:
    """Read, predict, write; returns one row ``path, n_rows`` counted on the written output.

    ``options`` are those of ``read_csv``, such as ``multi_line=False``.

    The count reads the output again because a predictor may give other values when it is run twice.
    """
    write_csv(predict(read_products(spark, products_path, **options), predictor), output_path, mode)
    written = read_submission(spark, output_path)
    return written.agg(F.lit(output_path).alias("path"), F.count("*").alias("n_rows"))
