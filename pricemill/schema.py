"""Table layouts and the fixed values of the task."""

from pyspark.sql import types as T

TEST_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("catalog_content", T.StringType()),
        T.StructField("image_link", T.StringType()),
    ]
)
TRAIN_SCHEMA = T.StructType([*TEST_SCHEMA.fields, T.StructField("price", T.DoubleType())])
SUBMISSION_SCHEMA = T.StructType(
    [T.StructField("sample_id", T.LongType()), T.StructField("price", T.DoubleType())]
)
FETCH_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# Sizes, seeds and bounds that results depend on.
CHUNK_ROWS = 37_500
SAMPLE_ROWS = 50
SAMPLE_SEED = 42
PUBLIC_ROWS = 25_000
PRICE_LOW = 5.0
PRICE_HIGH = 500.0
FETCH_TASKS = 100
FETCH_THREADS = 8

# Texts a pandas CSV read takes for missing (exact match, quoted or not).
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
