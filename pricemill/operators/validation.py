"""Is a submission complete, free of repeats and priced with positive numbers?"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.errors import bad_price, mae_of, not_a_number, r2_of, rmse_of, smape_of

_FAULTS = ("missing", "extra", "dup_ids", "bad_price", "dup_truth")


def _counts() -> list[Column]:
    wanted, got = F.col("expected") > 0, F.col("got")
    return [
        F.count_if(wanted).alias("n_expected"),
        F.coalesce(F.sum("got"), F.lit(0)).alias("n_got"),
        F.count_if(wanted & (got == 0)).alias("missing"),
        F.count_if(~wanted & (got > 0)).alias("extra"),
        F.count_if(got > 1).alias("dup_ids"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_price"),
        F.count_if(F.col("expected") > 1).alias("dup_truth"),
    ]


def no_faults() -> Column:
    """True where all fault counts are 0."""
    return reduce(Column.__and__, [F.col(fault) == 0 for fault in _FAULTS])


def by_id(submission: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per id of either table.

    Both tables go through one grouping, which counts rows per id before the shuffle: an id repeated
    any number of times reaches the shuffle as one row per task.
    """
    nothing = F.lit(None).cast("double")
    got = submission.select(
        "sample_id",
        F.lit(0).alias("expected"),
        F.lit(1).alias("got"),
        bad_price("price").cast("int").alias("bad"),
        F.col("price").alias("predicted"),
        nothing.alias("actual"),
    )
    wanted = expected.select(
        "sample_id",
        F.lit(1).alias("expected"),
        F.lit(0).alias("got"),
        F.lit(0).alias("bad"),
        nothing.alias("predicted"),
        (F.col("price") if "price" in expected.columns else nothing).alias("actual"),
    )
    return (
        got.unionByName(wanted)
        .groupBy("sample_id")
        .agg(
            F.sum("expected").alias("expected"),
            F.sum("got").alias("got"),
            F.sum("bad").alias("bad"),
            F.max("predicted").alias("predicted"),
            F.max("actual").alias("actual"),
        )
    )


def check_submission(submission: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ``n_expected, n_got, missing, extra, dup_ids, bad_price, dup_truth, ok``.

    ``n_got`` and ``bad_price`` count rows, the others ids. ``dup_truth`` counts the expected ids that come
    more than once: no submission can be right against such a table, so ``ok`` is false then.
    """
    return by_id(submission, expected.select("sample_id")).agg(*_counts()).withColumn("ok", no_faults())


def evaluate_submission(submission: DataFrame, truth: DataFrame) -> DataFrame:
    """The check of ``check_submission`` and the error metrics, in one pass over both tables.

    A submission that fails the check is not scored: its metrics are null.
    """
    predicted, actual = F.col("predicted"), F.col("actual")
    checked = (
        by_id(submission, truth)
        .agg(
            *_counts(),
            F.count_if((F.col("expected") > 0) & not_a_number(actual)).alias("bad_truth"),
            smape_of(predicted, actual).alias("smape"),
            mae_of(predicted, actual).alias("mae"),
            rmse_of(predicted, actual).alias("rmse"),
            r2_of(predicted, actual).alias("r2"),
        )
        .withColumn("ok", no_faults())
    )
    scored = F.col("ok") & (F.col("bad_truth") == 0)
    return checked.select(
        *["n_expected", "n_got", *_FAULTS, "ok"],
        *[F.when(scored, F.col(m)).alias(m) for m in ("smape", "mae", "rmse", "r2")],
    )
