"""Errors by segment, and how firm a rank is."""

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.functions.errors import mae_of, r2_of, rmse_of, smape_of, smape_term
from pricemill.functions.hashing import seeded_digest
from pricemill.schema import SAMPLE_SEED

PRICE_BANDS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 1500.0, 2000.0)
REPLICATES = 100
_MOST_DRAWS = 8


def price_band(price: str | Column, edges: Sequence[float] = PRICE_BANDS) -> Column:
    """The band of a price as ``from-to``, the upper edge outside; null for null and NaN."""
    price = F.col(price) if isinstance(price, str) else price
    if list(edges) != sorted(set(edges)) or not edges:
        raise ValueError(f"the edges of the bands must rise: {list(edges)}")
    texts = [f"{e:g}" for e in edges]
    band = F.when(price.isNull() | F.isnan(price), F.lit(None).cast("string")).when(price < edges[0], f"under {texts[0]}")
    for high, low_text, high_text in zip(edges[1:], texts, texts[1:]):
        band = band.when(price < high, f"{low_text}-{high_text}")
    return band.otherwise(f"{texts[-1]} and over")


def error_by_segment(
    predictions: DataFrame, truth: DataFrame, segments: Sequence[str], bands: Sequence[float] = PRICE_BANDS
) -> DataFrame:
    """Errors per price band, per segment, per band and segment, and over all, from one pass over the pairs.

    ``truth`` has ``sample_id, price`` and the columns ``segments``; the band is that of the true price. Columns:
    ``band``, the segments, ``grouping`` (the bits of the columns that are summed over, band highest: 0 is the
    finest), ``n_truth``, ``n_scored``, ``smape, mae, rmse, r2`` over the rows that have both prices. A null
    segment is told from a total by ``grouping``. The true rows are the base, so a missing prediction shows as
    ``n_scored < n_truth``. Both sides are reduced to one row per id before they meet; an id that is repeated
    counts with its largest price, as on the leaderboard. The sets of groups are made from partial sums: every
    task sends at most one row per group.
    """
    per_id = predictions.groupBy("sample_id").agg(F.max("price").alias("predicted"))
    known = truth.groupBy("sample_id").agg(F.max(F.struct("price", *segments)).alias("t"))
    known = known.select("sample_id", F.col("t.price").alias("actual"), *[F.col(f"t.`{s}`") for s in segments])
    usable = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in (F.col("predicted"), F.col("actual"))]
    pairs = known.join(per_id, "sample_id", "left").withColumn("band", price_band("actual", bands))
    both = usable[0].isNotNull() & usable[1].isNotNull()
    pairs = pairs.select("band", *segments, F.when(both, F.col("predicted")).alias("p"), F.when(both, F.col("actual")).alias("a"))
    p, a = F.col("p"), F.col("a")
    return pairs.cube("band", *segments).agg(
        F.grouping_id().cast("long").alias("grouping"),
        F.count("*").alias("n_truth"),
        F.count("p").alias("n_scored"),
        smape_of(p, a).alias("smape"),
        mae_of(p, a).alias("mae"),
        rmse_of(p, a).alias("rmse"),
        r2_of(p, a).alias("r2"),
    )


def draw_bits(seed, key: str | Column, replicate: Column) -> Column:
    """16 bits fixed by seed, key and replicate: eight replicates share a digest of seed, key and their number over 8."""
    digest = seeded_digest(seed, key, F.floor(replicate / 8))
    return F.conv(F.substring(digest, (replicate % 8) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def poisson_of(bits: Column) -> Column:
    """0, 1, 2, ... with the chances of a Poisson variable of mean 1, within 1 in 65,536."""
    draws, chance, upto = F.lit(0), exp(-1), 0.0
    for k in range(_MOST_DRAWS):
        upto += chance
        draws = draws + (bits >= int(upto * 65536 + 0.5)).cast("int")
        chance /= k + 1
    return draws


def leaderboard_bootstrap(
    submissions: DataFrame, truth: DataFrame, replicates: int = REPLICATES, seed=SAMPLE_SEED, share: float = 0.95
) -> DataFrame:
    """``submission_id, n_scored, smape, rank, low_rank, high_rank, first_share`` per submission.

    A Poisson bootstrap: in each replicate every true id counts 0, 1, 2, ... times, by a hash of id and
    replicate, so all submissions of a replicate are ranked on the same draw and reruns agree. ``low_rank`` and
    ``high_rank`` hold the middle ``share`` of the replicates' ranks, ``first_share`` is the share of
    replicates that a submission leads. Submissions are scored over the true ids they have a finite price for;
    those without any are left out, as they have no rank.

    One pass: rows are first one per submission and id; weights are made per id and replicate where the pair
    is read, and summed before the shuffle, so a task sends one row per submission and replicate whatever
    it reads. Ranks are taken over submissions within a replicate, one row each.
    """
    if replicates < 1 or not 0 < share <= 1:
        raise ValueError("replicates must be at least 1 and share between 0 and 1")
    per_id = submissions.groupBy("submission_id", "sample_id").agg(F.max("price").alias("predicted"))
    known = truth.groupBy("sample_id").agg(F.max("price").alias("actual"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("predicted", "actual")]
    pairs = per_id.join(known, "sample_id").filter(finite[0] & finite[1])
    pairs = pairs.select("submission_id", "sample_id", smape_term(F.col("predicted"), F.col("actual")).alias("term"))
    # Replicate 0 is the table itself.
    drawn = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("bits", draw_bits(seed, "sample_id", F.col("replicate")))
    sums = (
        drawn.withColumn("w", F.when(F.col("replicate") == 0, 1).otherwise(poisson_of(F.col("bits"))))
        .groupBy("submission_id", "replicate")
        .agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("term")) / F.sum("w")).alias("score"))
        .filter("n > 0")
        .withColumn("score", F.round("score", 6))
    )
    ranked = sums.withColumn("rank", F.rank().over(Window.partitionBy("replicate").orderBy("score")))
    copies = F.col("replicate") > 0
    tail = (1 - share) / 2
    order = Window.partitionBy("submission_id").orderBy("rank", "replicate").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.filter(copies).withColumns(
        {"at": F.count("*").over(order), "of": F.count("*").over(Window.partitionBy("submission_id"))}
    )
    low = F.min(F.when(F.col("at") >= F.col("of") * tail, F.col("rank")))
    high = F.min(F.when(F.col("at") >= F.col("of") * (1 - tail), F.col("rank")))
    intervals = placed.groupBy("submission_id").agg(
        low.alias("low_rank"), high.alias("high_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("first_share")
    )
    whole = ranked.filter(~copies).select("submission_id", F.col("n").alias("n_scored"), F.col("score").alias("smape"), "rank")
    return whole.join(intervals, "submission_id", "left")
