"""Preparing a catalog for a model: holdout, cleaning, outliers, pack quantity, ensemble."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.hashing import unit_hash
from pricemill.operators.quantiles import exact_quantiles
from pricemill.schema import SAMPLE_SEED

PACK_PATTERN = r"(?i)\bpack of (\d+)"


def in_holdout(key: str | list[str] = "sample_id", share: float = 0.1, seed=SAMPLE_SEED) -> Column:
    """Condition that is true for about ``share`` of the keys: a hash of the key alone decides.

    Rows that share a key stay on one side, new rows never move old ones, and no shuffle is needed.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"share must be from 0 to 1, not {share}")
    return unit_hash(seed, *([key] if isinstance(key, str) else key)) < share


def clean(products: DataFrame) -> DataFrame:
    """Products with one row per id and usable text; the price, if there is one, positive and finite.

    Text is trimmed and rows without text are left out. Of several rows with one id the smallest by text,
    link and price stays: a partial minimum, so an id repeated any number of times is one row per task.
    """
    text = F.trim(F.regexp_replace("catalog_content", r"\s+", " "))
    rows = products.withColumn("catalog_content", text).filter(
        F.col("sample_id").isNotNull() & (F.col("catalog_content") != "")
    )
    if "price" in products.columns:
        rows = rows.filter((F.col("price") > 0) & (F.col("price") < float("inf")))
    rest = [F.col(f"`{c}`") for c in products.columns if c != "sample_id"]
    first = rows.groupBy("sample_id").agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(*[F.col(c) if c == "sample_id" else F.col(f"first.`{c}`") for c in products.columns])


def price_fences(products: DataFrame, k: float = 1.5, price: str = "price") -> DataFrame:
    """One row ``q1, q3, low, high``: exact quartiles of the prices and the fences k spreads beyond them.

    The quartiles are the lowest prices that at least a quarter and three quarters of the rows do not
    exceed, found by ``exact_quantiles``: a few counting scans of the price column, no sort. Null, NaN and no
    rows at all give no quartile.
    """
    q1, q3 = exact_quantiles(products, price, (0.25, 0.75))
    quartiles = products.sparkSession.range(1).select(
        F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3")
    )
    spread = k * (F.col("q3") - F.col("q1"))
    return quartiles.select("q1", "q3", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def flag_outliers(products: DataFrame, k: float = 1.5, price: str = "price") -> DataFrame:
    """Add ``outlier``: the price lies outside the fences; null where the price is null or NaN."""
    low, high = price_fences(products, k, price).select("low", "high").first()
    value = F.when(~F.isnan(price), F.col(price))
    return products.withColumn("outlier", (value < low) | (value > high))


def ensemble(members: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """``sample_id, price, n_members, missing_weight``: the weighted mean of several predictions per id.

    The mean is over the members that have a price for the id, so a missing member is seen in the counts
    and does not pull the price to zero. A member that repeats an id counts with the mean of its prices.
    One grouping by id of all members, no joins.
    """
    whole = float(sum(weight for _, weight in members.values()))
    if not members or min(weight for _, weight in members.values()) <= 0:
        raise ValueError("every member needs a positive weight")
    tables = [
        table.select("sample_id", "price", F.lit(name).alias("member"), F.lit(float(weight)).alias("weight"))
        for name, (table, weight) in members.items()
    ]
    usable = F.col("price").isNotNull() & ~F.isnan("price")
    per_member = (
        reduce(DataFrame.unionByName, tables)
        .groupBy("sample_id", "member", "weight")
        .agg(F.avg(F.when(usable, F.col("price"))).alias("price"))
    )
    held = F.sum(F.when(F.col("price").isNotNull(), F.col("weight")))
    return per_member.groupBy("sample_id").agg(
        (F.sum(F.col("price") * F.col("weight")) / held).alias("price"),
        F.count("price").alias("n_members"),
        (F.lit(whole) - F.coalesce(held, F.lit(0.0))).alias("missing_weight"),
    )


def pack_quantity(text: str | Column = "catalog_content", pattern: str = PACK_PATTERN) -> Column:
    """The whole number in the first group of the first match; null without a match."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).try_cast("bigint"))
