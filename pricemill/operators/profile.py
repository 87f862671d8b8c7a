"""Column profiles: exact counts, and sketches that are stored per part and merged later."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 2**12 registers: a relative standard error of about 1.6 % in the distinct values, exact while they are few.
LOG_REGISTERS = 12
# Three standard errors.
DISTINCT_ERROR = 0.05
# Size of the quantile sketch: ranks are right within about 1.3 % (normalised, 99 % of the time).
QUANTILE_K = 200
RANK_ERROR = 0.02


def _numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _length(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return F.length(column) if isinstance(field.dataType, T.StringType) else F.lit(None).cast("int")


def _value(field: T.StructField) -> Column:
    """What distinct values are told apart by: texts as they are, all else as its text."""
    column = F.col(f"`{field.name}`")
    return column if isinstance(field.dataType, T.StringType) else column.cast("string")


def _entries(fields, parts) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), *parts(i, f)) for i, f in enumerate(fields)])).alias("e")


def profile(products: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, distinct values and, for text, shortest and longest length.

    One pass for all counts but the distinct ones. For these every value is hashed to 128 bits where it is
    read, and column and hash of all columns go through one distinct that is partial before its shuffle: no
    text is moved, and a value repeated any number of times is one row per task.
    """
    fields = products.schema.fields
    columns = []
    for i, field in enumerate(fields):
        columns += [F.count_if(F.col(f"`{field.name}`").isNull()).alias(f"nulls_{i}")]
        columns += [F.min(_length(field)).alias(f"short_{i}"), F.max(_length(field)).alias(f"long_{i}")]
    counts = products.agg(F.count("*").alias("n_rows"), *columns)
    per_column = counts.select(
        _entries(
            fields,
            lambda i, f: [
                F.col("n_rows"),
                F.col(f"nulls_{i}").alias("n_nulls"),
                F.col(f"short_{i}").alias("shortest"),
                F.col(f"long_{i}").alias("longest"),
            ],
        )
    ).select("e.*")
    hashes = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.xxhash64(_value(f)).alias("h"), F.xxhash64(_value(f), F.lit(1)).alias("g"), _value(f).isNull().alias("none"))
            for i, f in enumerate(fields)
        ]
    )
    values = products.select(F.explode(hashes).alias("v")).filter("not v.none").select("v.i", "v.h", "v.g").distinct()
    distinct = values.groupBy("i").agg(F.count("*").alias("n"))
    names = F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("i") + 1)
    distinct = distinct.select(names.alias("column"), "n")
    found = per_column.join(F.broadcast(distinct), "column", "left")
    return found.select(
        "column", "n_rows", "n_nulls", "shortest", "longest", F.coalesce("n", F.lit(0).cast("long")).alias("n_distinct")
    )


def sketch_profile(products: DataFrame, by: str | None = None) -> DataFrame:
    """One row per part and column with sketches that ``merge_profiles`` joins: store it and add to it.

    ``part`` is the text of the column ``by`` (null is a part of its own; one part without ``by``). The columns:
    ``n_rows, n_nulls, shortest, longest``, ``distinct_sketch`` (HyperLogLog) and, for numbers,
    ``quantile_sketch`` (KLL) with ``low`` and ``high``. Parts are aggregated before the shuffle, so a part may
    hold any share of the rows; a sketch takes a few kilobytes whatever it has seen. NaN is left out of the quantiles.
    """
    fields = [f for f in products.schema.fields if f.name != by]
    part = F.col(f"`{by}`").cast("string") if by else F.lit("all")
    columns = [F.count("*").alias("n_rows")]
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        columns += [F.count_if(column.isNull()).alias(f"nulls_{i}")]
        columns += [F.min(_length(field)).alias(f"short_{i}"), F.max(_length(field)).alias(f"long_{i}")]
        columns += [F.hll_sketch_agg(_value(field), F.lit(LOG_REGISTERS)).alias(f"distinct_{i}")]
        if _numeric(field):
            number = column.cast("double")
            number = F.when(~F.isnan(number), number)
            columns += [F.kll_sketch_agg_double(number, F.lit(QUANTILE_K)).alias(f"quantile_{i}")]
            columns += [F.min(number).alias(f"low_{i}"), F.max(number).alias(f"high_{i}")]
    grouped = products.groupBy(part.alias("part")).agg(*columns)

    def parts(i, field):
        number = _numeric(field)
        return [
            F.col("n_rows"),
            F.col(f"nulls_{i}").alias("n_nulls"),
            F.col(f"short_{i}").alias("shortest"),
            F.col(f"long_{i}").alias("longest"),
            F.col(f"distinct_{i}").alias("distinct_sketch"),
            (F.col(f"quantile_{i}") if number else F.lit(None).cast("binary")).alias("quantile_sketch"),
            (F.col(f"low_{i}") if number else F.lit(None).cast("double")).alias("low"),
            (F.col(f"high_{i}") if number else F.lit(None).cast("double")).alias("high"),
        ]

    return grouped.select("part", _entries(fields, parts)).select("part", "e.*")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One row per column of stored part profiles, whatever parts they come from.

    ``n_rows, n_nulls, shortest, longest, low, high`` are exact; ``n_distinct`` is within ``DISTINCT_ERROR`` and
    the quartiles ``q1, median, q3`` of a number column within ``RANK_ERROR`` of their ranks. Only sketches are read.
    """
    merged = profiles.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("sketch"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    has = F.col("low").isNotNull()
    at = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = [F.when(has, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for name, q in at.items()]
    return merged.select("column", "n_rows", "n_nulls", "shortest", "longest", "n_distinct", "low", *quartiles, "high")


def write_profile(products: DataFrame, path: str, by: str | None = None) -> None:
    """Add the part profiles of ``products`` to the stored ones."""
    sketch_profile(products, by).write.mode("append").parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The merged profile of everything that was stored."""
    return merge_profiles(spark.read.parquet(path))
