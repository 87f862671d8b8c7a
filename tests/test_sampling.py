import hashlib

import pytest
from pyspark.sql import functions as F

from pricemill.operators.sampling import in_sample, sample_exact


def brute_force(ids, n, seed):
    return set(sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:n])


def ids_of(df):
    return [r.id for r in df.select("id").collect()]


@pytest.mark.parametrize("n", [0, 1, 50, 1234, 2999, 3000])
def test_exact_and_equal_to_brute_force(spark, n):
    got = ids_of(sample_exact(spark.range(3000), n, "id", 42))
    assert len(got) == n and set(got) == brute_force(range(3000), n, 42)


def test_more_rows_than_there_are(spark):
    with pytest.raises(ValueError, match="31 rows out of 30"):
        sample_exact(spark.range(30), 31, "id")
    with pytest.raises(ValueError, match="1 rows out of 0"):
        sample_exact(spark.range(0), 1, "id")
    with pytest.raises(ValueError):
        sample_exact(spark.range(30), -1, "id")
    assert sample_exact(spark.range(0), 0, "id").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_same_rows_on_any_partitioning(spark, parts):
    df = spark.range(4000).repartition(parts)
    assert set(ids_of(sample_exact(df, 50, "id", 42))) == brute_force(range(4000), 50, 42)
    assert set(ids_of(sample_exact(df, 1500, "id", 42))) == brute_force(range(4000), 1500, 42)


def test_seed_changes_the_sample(spark):
    a = set(ids_of(sample_exact(spark.range(4000), 50, "id", 1)))
    b = set(ids_of(sample_exact(spark.range(4000), 50, "id", 2)))
    assert a != b


def test_copies_of_a_key_at_the_cutoff(spark):
    third_is_one_key = spark.range(900).withColumn(
        "k", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    )
    keys = sorted(
        (-1 if i % 3 == 0 else i for i in range(900)),
        key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest(),
    )
    hot_start = keys.index(-1)
    for n in (hot_start, hot_start + 10, hot_start + 300):
        got = [r.k for r in sample_exact(third_is_one_key, n, "k", 42).collect()]
        assert sorted(got) == sorted(keys[:n])
    with pytest.raises(ValueError, match="unique"):
        in_sample(third_is_one_key, hot_start + 10, "k", 42)
    first = set(ids_of(sample_exact(third_is_one_key, hot_start + 10, "k", 42)))
    again = set(ids_of(sample_exact(third_is_one_key.repartition(5), hot_start + 10, "k", 42)))
    assert first == again and len(first) == hot_start + 10


def test_null_keys_take_part(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") > 0, F.col("id")))
    assert sample_exact(df, 100, "k").count() == 100


def test_condition_works_on_another_table(spark):
    condition = in_sample(spark.range(500), 100, "id", 9)
    other = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert set(ids_of(other.filter(condition).filter("id < 500"))) == brute_force(range(500), 100, 9)


def test_sample_plan_is_one_filtered_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = sample_exact(orders, 5000, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Filter" in plan


def test_first_sampled_orders(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = {r.o_orderkey for r in sample_exact(orders, 5, "o_orderkey", 42).collect()}
    assert got == {10834, 897, 13916, 1443, 13467}
