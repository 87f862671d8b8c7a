"""Exact quantiles without a sort: radix selection over the ordered bits of a double."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits fixed per pass; a pass groups into at most 2**16 values per open rank.
_DIGIT_BITS = 16
_SMALLEST = -(1 << 63)


def ordered_bits(value: str | Column) -> Column:
    """A long that orders like the double: its bits, with all but the sign turned over below zero.

    Both zeros are one value. NaN, which SQL counts as the largest value, gets the largest bits.
    """
    value = (F.col(value) if isinstance(value, str) else value).cast("double") + F.lit(0.0)
    bits = F.call_function(
        "java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value, F.lit(0.0))
    ).cast("long")
    ordered = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.when(value.isNotNull(), ordered)


def nth_values(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values at the given places (from 0) of the sorted column; nulls and NaN are left out.

    A pass counts rows per leading 16 bits of the ordered value, then per next 16 bits inside the values
    that hold a wanted place, and so on: at most four scans of one column, each an aggregate that is
    partial before its shuffle. A place is settled early once its bits hold a single value. Nothing is
    sorted, staged or collected; per pass one row per open place reaches the driver. A place outside the
    rows raises ``IndexError``.
    """
    plain = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    keyed = plain.select(F.col("v") + F.lit(0.0), ordered_bits("v").bitwiseXOR(F.lit(_SMALLEST)).alias("u")).toDF("v", "u")
    # Open places by the bits known so far: {(prefix, width): {place: place inside the prefix}}.
    open_places: dict[int, dict[int, int]] = {0: {rank: rank for rank in ranks}}
    found: dict[int, float] = {}
    for width in range(0, 64, _DIGIT_BITS):
        if not any(open_places.values()):
            break
        shift = 64 - width - _DIGIT_BITS
        head = F.shiftrightunsigned("u", shift + _DIGIT_BITS) if width else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("u", shift).bitwiseAND((1 << _DIGIT_BITS) - 1)
        inside = keyed.select("v", head.alias("head"), digit.alias("digit")).filter(F.col("head").isin(list(open_places)))
        counts = inside.groupBy("head", "digit").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        running = Window.partitionBy("head").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(running))
        wanted = [(p, place, at) for p, places in open_places.items() for place, at in places.items()]
        asked = df.sparkSession.createDataFrame(wanted, "head long, place long, at long")
        # One row per open place, joined to at most 2**16 counts per prefix.
        hits = upto.join(F.broadcast(asked), "head").filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
        open_places, settled = {}, 0
        for hit in hits.collect():
            settled += 1
            if hit.low == hit.high:
                found[hit.place] = hit.low
            else:
                prefix = (hit.head << _DIGIT_BITS) | hit.digit
                open_places.setdefault(prefix, {})[hit.place] = hit.at - (hit.upto - hit.n)
        if settled < len(wanted):
            raise IndexError(f"there are fewer rows than one of the places {sorted(p for _, p, _ in wanted)}")
    return [found[rank] for rank in ranks]


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """For each share, the lowest value that at least this share of the values does not exceed.

    Nulls and NaN are left out; without values every quantile is None. See ``nth_values`` for the plan.
    """
    if any(not 0 <= share <= 1 for share in shares):
        raise ValueError(f"shares must be from 0 to 1, not {list(shares)}")
    usable = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    n = df.agg(F.count_if(usable)).first()[0]
    if n == 0:
        return [None] * len(shares)
    # ceil(share * n) - 1, in whole numbers where the share is a fraction of them.
    ranks = [max(0, -int(-(share * n) // 1) - 1) for share in shares]
    return nth_values(df, column, ranks)
