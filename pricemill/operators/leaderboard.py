"""Scoring and ranking many submissions held in one table ``submission_id, sample_id, price``."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.functions.errors import bad_price, not_a_number, smape_of
from pricemill.operators.sampling import in_sample
from pricemill.operators.validation import no_faults
from pricemill.schema import PUBLIC_ROWS, SAMPLE_SEED

# Digits a score is rounded to before ranking: sums of doubles differ in the last bits from run to run.
SCORE_DIGITS = 6


def score_submissions(
    submissions: DataFrame, truth: DataFrame, public: Column, listed: DataFrame | None = None
) -> DataFrame:
    """One row per submission: the check counts, ``ok``, ``public_smape`` and ``final_smape``.

    ``public`` is a condition on ``sample_id``. A submission that is incomplete, has extra or repeated
    ids or bad prices is not scored; if the truth repeats an id (``dup_truth``), none is. ``listed`` has a
    column ``submission_id``: one that is listed and has no row is a row with nothing got. Rows are first
    grouped by submission and id, and the truth by id, so that an id repeated many times is one row before
    the join.
    """
    per_id = submissions.groupBy("submission_id", "sample_id").agg(
        F.count("*").alias("rows"),
        F.sum(bad_price("price").cast("int")).alias("bad"),
        F.max("price").alias("predicted"),
    )
    known = truth.groupBy("sample_id").agg(F.max("price").alias("actual"), F.count("*").alias("copies"))
    n_expected = known.agg(F.count("*").alias("n")).scalar()
    dup_truth = known.agg(F.count_if(F.col("copies") > 1).alias("n")).scalar()
    bad_truth = truth.agg(F.count_if(not_a_number("price")).alias("n")).scalar()
    known = known.select("sample_id", "actual", public.alias("public"), F.lit(True).alias("known"))
    predicted, actual, shown = F.col("predicted"), F.col("actual"), F.col("public")
    counts = (
        per_id.join(known, "sample_id", "left")
        .groupBy("submission_id")
        .agg(
            F.sum("rows").alias("n_got"),
            F.count("known").alias("n_known"),
            F.count_if(F.col("known").isNull()).alias("extra"),
            F.count_if(F.col("rows") > 1).alias("dup_ids"),
            F.sum("bad").alias("bad_price"),
            F.count_if(shown).alias("n_public"),
            smape_of(F.when(shown, predicted), actual).alias("public_smape"),
            smape_of(predicted, actual).alias("final_smape"),
        )
    )
    if listed is not None:
        counts = listed.select("submission_id").distinct().join(counts, "submission_id", "left").fillna(0)
    counts = counts.withColumns({"missing": n_expected - F.col("n_known"), "dup_truth": dup_truth})
    scored = F.col("ok") & (bad_truth == 0)
    return counts.withColumn("ok", no_faults()).select(
        *["submission_id", "n_got", "missing", "extra", "dup_ids", "bad_price", "dup_truth", "ok", "n_public"],
        *[
            F.when(scored, F.round(s, SCORE_DIGITS)).alias(s)
            for s in ("public_smape", "final_smape")
        ],
    )


def _public_rows(truth: DataFrame, n_public: int, seed) -> Column:
    return in_sample(truth.select("sample_id").distinct(), n_public, "sample_id", seed)


def public_score(
    submissions: DataFrame, truth: DataFrame, n_public: int = PUBLIC_ROWS, seed=SAMPLE_SEED
) -> DataFrame:
    """SMAPE of each submission on a fixed subset of ``n_public`` truth rows."""
    scores = score_submissions(submissions, truth, _public_rows(truth, n_public, seed))
    return scores.select("submission_id", "n_public", "ok", F.col("public_smape").alias("smape"))


def leaderboard(
    submissions: DataFrame,
    truth: DataFrame,
    n_public: int = PUBLIC_ROWS,
    seed=SAMPLE_SEED,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Rank of each submission, lowest SMAPE first, on the public subset and on all truth rows.

    Equal scores share a rank; a submission that is not scored has none. Only the scores, one row per
    submission, are ranked. ``listed`` as in ``score_submissions``.
    """
    scores = score_submissions(submissions, truth, _public_rows(truth, n_public, seed), listed)

    def place(score):
        return F.when(
            F.col(score).isNotNull(), F.rank().over(Window.orderBy(F.col(score).asc_nulls_last()))
        )

    return scores.select(
        "submission_id",
        "ok",
        "public_smape",
        place("public_smape").alias("public_rank"),
        "final_smape",
        place("final_smape").alias("final_rank"),
    )
