"""Text features and a learned price model from ``pyspark.ml``."""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.functions.errors import smape_of

N_FEATURES = 512


def text_pipeline(n_features: int = N_FEATURES, text: str = "catalog_content") -> Pipeline:
    """Words in lower case, hashed counts, weighted by how rare a word is; ``features`` is a sparse vector."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+"),
            HashingTF(inputCol="words", outputCol="counts", numFeatures=n_features),
            IDF(inputCol="counts", outputCol="features"),
        ]
    )


def _texts(products: DataFrame) -> DataFrame:
    return products.withColumn("catalog_content", F.coalesce("catalog_content", F.lit("")))


def text_features(products: DataFrame, n_features: int = N_FEATURES) -> DataFrame:
    """Add ``features``; a null text has none. The weights come from one pass over all texts."""
    texts = _texts(products)
    return text_pipeline(n_features).fit(texts).transform(texts).drop("words", "counts")


@dataclass
class PriceModel:
    """A fitted pipeline, the SMAPE of its prices on the holdout, and that of the train median."""

    pipeline: PipelineModel
    model_smape: float
    median_smape: float
    median: float

    @property
    def accepted(self) -> bool:
        return self.model_smape < self.median_smape

    def predict(self, products: DataFrame) -> DataFrame:
        """``sample_id, price``: the model's price, or the train median if that did better."""
        if not self.accepted:
            return products.select("sample_id", F.lit(self.median).alias("price"))
        return _priced(self.pipeline, products).select("sample_id", "price")


def _priced(pipeline: PipelineModel, products: DataFrame) -> DataFrame:
    return pipeline.transform(_texts(products)).withColumn("price", F.exp("prediction"))


def fit_price_model(train: DataFrame, holdout: DataFrame, n_features: int = N_FEATURES, ridge: float = 0.1) -> PriceModel:
    """Ridge regression of the logarithm of the price on the text features.

    Rows without a positive finite price are left out. The fit adds up products of features in the tasks:
    the driver holds ``n_features`` squared numbers, whatever the number of rows.
    """
    usable = (F.col("price") > 0) & (F.col("price") < float("inf"))
    train = _texts(train).filter(usable).withColumn("log_price", F.log("price"))
    holdout = holdout.filter(usable).withColumn("actual", F.col("price"))
    median = train.agg(F.percentile_approx("price", 0.5, 10_000)).first()[0]
    if median is None:
        raise ValueError("there is no row to learn from")
    regression = LinearRegression(labelCol="log_price", regParam=ridge, solver="normal")
    stages = [*text_pipeline(n_features).getStages(), regression]
    pipeline = Pipeline(stages=stages).fit(train)
    scores = _priced(pipeline, holdout).agg(
        smape_of(F.col("price"), F.col("actual")), smape_of(F.lit(median), F.col("actual"))
    )
    model_smape, median_smape = scores.first()
    if model_smape is None:
        raise ValueError("there is no row to hold out")
    return PriceModel(pipeline, model_smape, median_smape, median)
