"""Applying a price predictor to a product table."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.hashing import hash_price
from pricemill.schema import SAMPLE_SEED

Predictor = Callable[[DataFrame], Column]

INPUTS = ("sample_id", "catalog_content", "image_link")


def hash_predictor(seed=SAMPLE_SEED) -> Predictor:
    """Stand-in model: a uniform price fixed by seed and id."""
    return lambda products: hash_price(seed, "sample_id")


def _predictor(
    price_of: Callable[..., Callable[[list[pa.Array]], pa.Array]], inputs: Sequence[str]
) -> Predictor:
    """Predictor from a maker of functions of Arrow columns; one function per task."""

    def prices(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        price = price_of()
        for batch in batches:
            yield price(list(batch))

    def prices_of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from prices((batch,) for batch in batches)

    udf = F.arrow_udf(prices_of_one if len(inputs) == 1 else prices, "double")
    return lambda products: udf(*[products[name] for name in inputs])


def batch_predictor(
    make_model: Callable[[], Callable[..., pd.Series]], inputs: Sequence[str] = INPUTS
) -> Predictor:
    """Predictor from Python code that works on whole batches.

    ``make_model`` runs once per task and returns a function of one Series per input column. Whole numbers
    are nullable ``Int64`` in every batch, with or without nulls. Only the input columns are sent to Python.
    """

    def price_of():
        model = make_model()
        types = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

        def price(columns):
            series = [column.to_pandas(types_mapper=types.get) for column in columns]
            return pa.array(pd.Series(model(*series)).astype("float64"), pa.float64(), from_pandas=True)

        return price

    return _predictor(price_of, inputs)


def row_predictor(function: Callable[..., float], inputs: Sequence[str] = INPUTS) -> Predictor:
    """Predictor from a plain function of one row, ``function(sample_id, catalog_content, image_link)``.

    Ids arrive as int and missing values as None, whatever else is in the batch. The function runs once
    per row: an adapter for a contract of single rows, not the way to write a model; a function that can
    work on whole columns is faster as a ``batch_predictor``.
    """

    def price_of():
        def price(columns):
            rows = zip(*[column.to_pylist() for column in columns])
            return pa.array([function(*row) for row in rows], pa.float64(), from_pandas=True)

        return price

    return _predictor(price_of, inputs)


def predict(products: DataFrame, predictor: Predictor | None = None) -> DataFrame:
    """``sample_id, price`` with the predicted price of every product."""
    price = (predictor or hash_predictor())(products)
    return products.select("sample_id", price.alias("price"))
