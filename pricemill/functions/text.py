"""Text rules of the CSV files: null tokens and number format."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemill.schema import NULL_TOKENS


def null_tokens_to_null(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(~text.isin(NULL_TOKENS), text)


def number_text(number: str | Column) -> Column:
    """A double as Python prints it: plain digits in [1e-4, 1e16), short exponent form outside.

    Spark switches to its exponent form ('2.0E7', '5.0E-4') much earlier. From 1e16 on, Java before
    version 19 may print one digit more than needed; the text still stands for the same number.
    """
    number = F.col(number) if isinstance(number, str) else number
    size = F.abs(number)
    spark_text = number.cast("string")

    def plain(decimal_type):
        return F.regexp_replace(
            F.rtrim(number.try_cast(decimal_type).cast("string"), F.lit("0")), r"\.$", ".0"
        )

    mantissa = F.regexp_replace(F.substring_index(spark_text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(spark_text, "E", -1).try_cast("int")
    short = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), spark_text)
        .when((size >= 1e7) & (size < 1e16), plain("decimal(38,22)"))
        .when((size >= 1e-4) & (size < 1e-3), plain("decimal(38,25)"))
        .otherwise(short)
    )
