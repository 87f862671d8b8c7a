"""Check, score and rank submission files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.operators.leaderboard import leaderboard
from pricemill.operators.validation import evaluate_submission
from pricemill.schema import PUBLIC_ROWS, SAMPLE_SEED, SUBMISSION_SCHEMA
from pricemill.sources.csv import read_csv, read_submission


def evaluate(spark: SparkSession, submission_path: str, truth: DataFrame) -> DataFrame:
    """Header and format are checked by the read, the rest in one pass; one row."""
    return evaluate_submission(read_submission(spark, submission_path), truth)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as file metadata shows it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return _plain(system.makeQualified(hadoop_path).toUri().toString())


def _plain(uri: str) -> str:
    return uri.replace("file:///", "file:/").rstrip("/")


def read_submissions(spark: SparkSession, submission_paths: dict[str, str]) -> DataFrame:
    """``submission_id, sample_id, price`` of one file or flat folder per submission id, in one read.

    All headers are compared in one job. The id follows from the file's path or folder; the list of paths
    is held by the driver already.
    """
    roots = [(_qualified(spark, path), name) for name, path in submission_paths.items()]
    if len({root for root, _ in roots}) < len(roots):
        raise ValueError("two submissions name one path")
    rows = read_csv(spark, list(submission_paths.values()), SUBMISSION_SCHEMA, multi_line=False, file_order=True)
    file = F.regexp_replace("source_file", "^file:///", "file:/")
    folder = F.regexp_replace(file, "/[^/]*$", "")
    # A row per submission that the caller has listed.
    of_file = F.broadcast(spark.createDataFrame(roots, "_file string, of_file string"))
    of_folder = F.broadcast(spark.createDataFrame(roots, "_folder string, of_folder string"))
    named = rows.withColumns({"_file": file, "_folder": folder}).join(of_file, "_file", "left").join(of_folder, "_folder", "left")
    return named.select(F.coalesce("of_file", "of_folder").alias("submission_id"), "sample_id", "price")


def rank(
    spark: SparkSession,
    submission_paths: dict[str, str],
    truth: DataFrame,
    n_public: int = PUBLIC_ROWS,
    seed=SAMPLE_SEED,
) -> DataFrame:
    """Leaderboard over one file or folder per submission id; an empty one is listed as not ok."""
    listed = spark.createDataFrame([(name,) for name in submission_paths], "submission_id string")
    return leaderboard(read_submissions(spark, submission_paths), truth, n_public, seed, listed)
