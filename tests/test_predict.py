import pandas as pd
from pyspark.sql import functions as F

from pricemill.operators.predict import batch_predictor, hash_predictor, predict, row_predictor
from pricemill.schema import TEST_SCHEMA

ROWS = [(1, "abc", "http://h/1.jpg"), (2, None, "http://h/2.jpg"), (3, "defgh", None)]


def prices(df):
    return {r.sample_id: r.price for r in df.collect()}


def table(spark):
    return spark.createDataFrame(ROWS, TEST_SCHEMA)


def test_default_predictor(spark):
    got = prices(predict(spark.range(3).select(F.col("id").alias("sample_id"))))
    assert got == {0: 331.96, 1: 177.19, 2: 236.71}
    assert prices(predict(table(spark), hash_predictor(1))) != prices(predict(table(spark)))


def test_column_predictor(spark):
    got = predict(table(spark), lambda products: F.length(products["catalog_content"]) * 2.0)
    assert prices(got) == {1: 6.0, 2: None, 3: 10.0}


def test_row_predictor_sees_python_values(spark):
    def price(sample_id, catalog_content, image_link):
        assert isinstance(sample_id, int)
        assert catalog_content is None or isinstance(catalog_content, str)
        return 100.0 * sample_id + len(catalog_content or "") + (image_link is None) * 0.5

    assert prices(predict(table(spark), row_predictor(price))) == {1: 103.0, 2: 200.0, 3: 305.5}


def test_row_predictor_may_give_none(spark):
    got = prices(predict(table(spark), row_predictor(lambda i, t, l: None if i == 2 else i)))
    assert got == {1: 1.0, 2: None, 3: 3.0}


def test_batch_predictor_builds_its_model_once_per_task(spark):
    def make_model():
        builds = []

        def model(sample_id, text):
            builds.append(len(builds))
            return pd.Series([float(len(builds))] * len(sample_id))

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(35).repartition(1).selectExpr("id as sample_id", "'x' as catalog_content")
        predictor = batch_predictor(make_model, ["sample_id", "catalog_content"])
        assert max(prices(predict(rows, predictor)).values()) == 4.0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_needed_columns_are_read(spark, sf_dir):
    products = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey as sample_id", "p_name as catalog_content", "p_type as image_link"
    )

    def read_columns(predictor):
        plan = predict(products, predictor)._jdf.queryExecution().executedPlan().toString()
        return plan.split("ReadSchema: ")[1].split("\n")[0]

    assert read_columns(None) == "struct<p_partkey:bigint>"
    only_text = batch_predictor(lambda: lambda t: t.str.len(), ["catalog_content"])
    assert read_columns(only_text) == "struct<p_partkey:bigint,p_name:string>"
