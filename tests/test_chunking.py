import glob

import pytest
from pyspark.sql import functions as F

from pricemill.operators import chunking
from pricemill.operators.chunking import assign_chunks, chunk_counts, row_index
from pricemill.schema import SUBMISSION_SCHEMA
from pricemill.sources.files import read_chunks, write_chunks
from pricemill.sources.staging import staged


def sizes(chunked):
    return [r.n_rows for r in chunk_counts(chunked).orderBy("chunk").collect()]


@pytest.mark.parametrize(
    "rows, chunk_rows, expected",
    [
        (0, 10, []),
        (1, 10, [1]),
        (10, 10, [10]),
        (7, 1, [1] * 7),
        (7, 100, [7]),
        (1003, 250, [250, 250, 250, 250, 3]),
    ],
)
def test_sizes(spark, rows, chunk_rows, expected):
    chunked = assign_chunks(spark.range(rows), "id", chunk_rows)
    assert sizes(chunked) == expected
    assert [c.chunk for c in chunk_counts(chunked).orderBy("chunk").collect()] == list(
        range(1, len(expected) + 1)
    )


def test_chunk_rows_must_be_positive(spark):
    with pytest.raises(ValueError):
        assign_chunks(spark.range(3), "id", 0)


def shuffled(spark, rows, parts):
    # Two thirds of the rows share one value of the first key.
    value = F.when(F.col("id") % 3 == 0, F.col("id") * 7919 % 1000).otherwise(500)
    return spark.range(rows).withColumn("v", value).repartition(parts, F.md5(F.col("id").cast("string")))


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("coalesce", [True, False])
def test_index_is_the_sort_position(spark, parts, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = [(r.v, r.id) for r in shuffled(spark, 5000, parts).collect()]
        indexed = row_index(shuffled(spark, 5000, parts), ["v", "id"])
        got = [(r.v, r.id) for r in indexed.orderBy("idx").collect()]
        assert got == sorted(rows)
        assert [r.idx for r in indexed.select("idx").orderBy("idx").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n_ranges", [1, 2, 11])
def test_number_of_ranges_does_not_matter(spark, n_ranges):
    indexed = row_index(shuffled(spark, 2000, 3), ["v", "id"], n_ranges)
    got = [(r.v, r.id) for r in indexed.orderBy("idx").collect()]
    assert len(got) == 2000 and got == sorted(got)


def test_hot_first_key_is_spread_over_ranges(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(chunking, "staged", lambda df, name: tables.append(staged(df, name)) or tables[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        row_index(shuffled(spark, 20000, 4), ["v", "id"])
        sizes_of_ranges = [r["count"] for r in tables[0].groupBy("_range").count().collect()]
        assert len(sizes_of_ranges) == 8 and max(sizes_of_ranges) < 2 * 20000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_keys_are_spread_and_keep_their_numbers(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(chunking, "staged", lambda df, name: tables.append(staged(df, name)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        numbers = []
        for parts in (1, 6):
            indexed = row_index(shuffled(spark, 20000, parts), "v")
            rows = sorted((r.idx, r.v, r.id) for r in indexed.collect())
            assert [r[0] for r in rows] == list(range(20000))
            assert [r[1] for r in rows] == sorted(r[1] for r in rows)
            numbers.append(rows)
            ranges = tables[-1].groupBy("_range").count().collect()
            assert max(r["count"] for r in ranges) < 2 * 20000 / 8
        assert numbers[0] == numbers[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_copies_are_spread_on_demand(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(chunking, "staged", lambda df, name: tables.append(staged(df, name)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        value = F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id"))
        rows = spark.range(24000).repartition(5).select(value.alias("v"), F.lit("x").alias("text"))
        indexed = row_index(rows, "v", spread_copies=True)
        assert indexed.columns == ["v", "text", "idx"]
        got = sorted((r.idx, r.v) for r in indexed.collect())
        assert [i for i, _ in got] == list(range(24000))
        assert [v for _, v in got] == sorted(5000 if i % 3 == 0 else i for i in range(24000))
        ranges = tables[-1].groupBy("_range").count().collect()
        assert len(ranges) == 8 and max(r["count"] for r in ranges) < 2 * 24000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_stays_the_same_on_every_use(spark):
    chunked = assign_chunks(spark.range(3000).withColumn("r", F.rand()), ["r", "id"], 100)
    first = {r.id: r.chunk for r in chunked.collect()}
    assert {r.id: r.chunk for r in chunked.repartition(3).collect()} == first


def priced(spark, rows):
    return spark.range(rows).select(
        F.col("id").alias("sample_id"), (F.col("id") * 7919 % rows + 0.5).alias("price")
    )


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_one_file_per_chunk_in_index_order(spark, tmp_path, file_format):
    chunked = assign_chunks(priced(spark, 1003), "price", 250)
    write_chunks(chunked, f"{tmp_path}/c", file_format)
    folders = sorted(glob.glob(f"{tmp_path}/c/chunk=*"))
    assert [f.rsplit("/", 1)[1] for f in folders] == [f"chunk={k}" for k in range(1, 6)]
    assert all(len(glob.glob(f"{f}/part-*")) == 1 for f in folders)
    back = read_chunks(spark, f"{tmp_path}/c", SUBMISSION_SCHEMA, file_format)
    assert sizes(back) == [250, 250, 250, 250, 3]
    one = [r.price for r in back.filter("chunk = 2").drop("chunk").collect()]
    assert one == sorted(one) and one[0] == 250.5 and one[-1] == 499.5
    assert dict(back.dtypes)["chunk"] == "bigint"


def test_large_chunks_can_be_written_without_a_shuffle(spark, tmp_path):
    chunked = assign_chunks(priced(spark, 1000), "price", 600, n_ranges=5)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        write_chunks(chunked, f"{tmp_path}/c", one_file=False)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    back = read_chunks(spark, f"{tmp_path}/c", SUBMISSION_SCHEMA)
    assert sizes(back) == [600, 400]
    files = glob.glob(f"{tmp_path}/c/chunk=1/part-*")
    assert len(files) > 1
    for name in files:
        prices = [r.price for r in spark.read.csv(name, header=True, schema=SUBMISSION_SCHEMA).collect()]
        assert prices == sorted(prices) and max(prices) < 600


def test_reading_one_chunk_opens_one_folder(spark, tmp_path):
    write_chunks(assign_chunks(priced(spark, 30), "price", 10), f"{tmp_path}/c")
    one = read_chunks(spark, f"{tmp_path}/c", SUBMISSION_SCHEMA).filter("chunk = 3")
    files = {r.f for r in one.select(F.input_file_name().alias("f")).collect()}
    assert {f.split("/")[-2] for f in files} == {"chunk=3"}
    assert "(chunk" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        write_chunks(assign_chunks(priced(spark, 3), "price", 2), f"{tmp_path}/c", "orc")
