"""Error metrics of predictions against true prices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.functions.errors import mae_of, not_a_number, r2_of, rmse_of, smape_of
from pricemill.operators.validation import by_id

METRICS = ("smape", "mae", "rmse", "r2")
_COUNTS = ("n_pairs", "n_bad", "n_missing", "n_extra", "n_repeated")


def error_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ids on both sides, faults, SMAPE (percent), MAE, RMSE, R2.

    ``n_bad`` counts pairs with a missing, NaN or infinite value, ``n_missing`` truth ids without a
    prediction, ``n_extra`` predicted ids without truth, ``n_repeated`` ids that either side holds more than
    once. Any of them makes every metric null: an incomplete output is not evaluated, and averages would
    skip or double such rows without a word. One grouping by id, no join: an id repeated any number of
    times is one row per task before the shuffle.
    """
    predicted, actual = F.col("predicted"), F.col("actual")
    wanted, got = F.col("expected") > 0, F.col("got") > 0
    totals = by_id(predictions, truth).agg(
        F.count_if(wanted & got).alias("n_pairs"),
        F.count_if(wanted & got & (not_a_number(predicted) | not_a_number(actual))).alias("n_bad"),
        F.count_if(wanted & ~got).alias("n_missing"),
        F.count_if(got & ~wanted).alias("n_extra"),
        F.count_if((F.col("expected") > 1) | (F.col("got") > 1)).alias("n_repeated"),
        smape_of(predicted, actual).alias("smape"),
        mae_of(predicted, actual).alias("mae"),
        rmse_of(predicted, actual).alias("rmse"),
        r2_of(predicted, actual).alias("r2"),
    )
    whole = F.expr(" + ".join(_COUNTS[1:])) == 0
    return totals.select(*_COUNTS, *[F.when(whole, F.col(m)).alias(m) for m in METRICS])


def smape(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the counts of ``error_metrics`` and SMAPE in percent."""
    return error_metrics(predictions, truth).select(*_COUNTS, "smape")
