"""Prediction error terms and their aggregates."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bad_price(price: str | Column) -> Column:
    """True unless the price is a positive finite number (NaN and infinity both compare as > 0)."""
    price = F.col(price) if isinstance(price, str) else price
    return price.isNull() | F.isnan(price) | (F.abs(price) == float("inf")) | (price <= 0)


def not_a_number(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def smape_term(predicted: Column, actual: Column) -> Column:
    """Symmetric relative error of one pair in percent, 0 to 200; 0 where both values are 0."""
    gap = F.abs(predicted - actual)
    mean = (F.abs(actual) + F.abs(predicted)) / 2
    return F.when(mean == 0, 0.0).otherwise(100 * (gap / mean))


def smape_of(predicted: Column, actual: Column) -> Column:
    return F.avg(smape_term(predicted, actual))


def mae_of(predicted: Column, actual: Column) -> Column:
    return F.avg(F.abs(predicted - actual))


def rmse_of(predicted: Column, actual: Column) -> Column:
    return F.sqrt(F.avg((predicted - actual) * (predicted - actual)))


def r2_of(predicted: Column, actual: Column) -> Column:
    """1 - residual / total sum of squares; null where the actual values do not vary."""
    residual = F.sum((predicted - actual) * (predicted - actual))
    total = F.var_pop(actual) * F.count(actual)
    return F.lit(1.0) - F.try_divide(residual, total)
