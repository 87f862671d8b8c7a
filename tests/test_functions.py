import hashlib
import math
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from pricemill.functions.errors import bad_price, smape_term
from pricemill.functions.hashing import hash_price, seeded_digest, unit_hash
from pricemill.functions.links import link_basename, target_path
from pricemill.functions.text import null_tokens_to_null, number_text
from pricemill.schema import NULL_TOKENS


def column(spark, values, type_name):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")


def results(df, expression):
    return [r.x for r in df.orderBy("i").select(expression.alias("x")).collect()]


def test_digest_is_md5_of_seed_and_key(spark):
    got = results(column(spark, [7], "bigint"), seeded_digest(42, "v"))
    assert got == [hashlib.md5(b"42:7").hexdigest()]
    two = results(column(spark, ["a"], "string"), seeded_digest(1, "v", "i"))
    assert two == [hashlib.md5(b"1:1:a:1:0").hexdigest()]


def test_several_keys_do_not_run_into_each_other(spark):
    rows = [("a:b", "c"), ("a", "b:c"), (None, "c"), ("c", None), ("", None), (None, None), ("-", "")]
    table = spark.createDataFrame(rows, "x string, y string")
    digests = [r[0] for r in table.select(seeded_digest(1, "x", "y")).collect()]
    assert len(set(digests)) == len(rows)


def test_hash_price_values(spark):
    assert results(column(spark, [0, 1, 2], "bigint"), hash_price(42, "v")) == [331.96, 177.19, 236.71]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_hash_price_does_not_depend_on_partitions(spark, parts):
    ids = spark.range(5000).repartition(parts)
    got = ids.select(
        F.sum(hash_price(42, "id").cast("decimal(20,2)")).alias("s"),
        F.min(unit_hash(42, "id")).alias("low"),
        F.max(unit_hash(42, "id")).alias("high"),
        F.min(hash_price(42, "id")).alias("cheapest"),
        F.max(hash_price(42, "id")).alias("dearest"),
    ).first()
    expected = sum(
        round(5 + 495 * (int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) / 2**32) * 1.0, 2)
        for i in range(5000)
    )
    assert math.isclose(float(got.s), expected, abs_tol=0.05)
    assert 0 <= got.low < got.high < 1 and 5 <= got.cheapest < got.dearest <= 500


LINKS = {
    "https://m/a/b.jpg": "b.jpg",
    "http://h/d/": "d",
    "http://h/b.jpg?x=1": "b.jpg?x=1",
    "http://h/x/.": "x",
    "a//b//": "b",
    "http://h": "h",
    "..": "..",
    ".": "",
    "/": "",
    "": "",
    "a/./.": "a",
    "a/../": "..",
    "...": "...",
    "/.hidden": ".hidden",
    "a b/c d": "c d",
    "/" * 3000 + "x": "x",
    "x" + "/." * 3000: "x",
    "/./" * 2000 + "é#1": "é#1",
}


def test_link_basename(spark):
    links = list(LINKS)
    got = results(column(spark, [*links, None], "string"), link_basename("v"))
    assert got == [*LINKS.values(), None]
    assert got[:-1] == [PurePosixPath(link).name for link in links]


def test_target_path(spark):
    df = column(spark, ["a.jpg"], "string")
    assert results(df, target_path("out", "v")) == ["out/a.jpg"]
    assert results(df, target_path("out/", "v")) == ["out/a.jpg"]


def test_null_tokens(spark):
    kept = [" NA", "NA ", "na", "none", "NONE", "x", " ", "-", "0"]
    got = results(column(spark, [*NULL_TOKENS, *kept], "string"), null_tokens_to_null("v"))
    assert got == [None] * len(NULL_TOKENS) + kept


def test_number_text_is_the_python_form(spark):
    rng = random.Random(5)
    values = [2e7, 5e-4, 1e-4, 9.999e-5, 1e-5, 1.5e-7, 9999999999999998.0, 1e16, 1.25e16, 1e22]
    values += [0.0, -0.0, 1e-3, 1e7, 123456789.12345678, 0.00012345678901234567, 100.0, 2.675, 1e-300]
    values += [rng.uniform(5, 500) for _ in range(2000)]
    values += [rng.uniform(1, 10) * 10.0 ** rng.randint(-12, 15) for _ in range(4000)]
    values += [-v for v in values]
    got = results(column(spark, values, "double"), number_text("v"))
    assert [(v, g) for v, g in zip(values, got) if g != repr(v)] == []


def test_number_text_of_huge_numbers_keeps_the_value(spark):
    rng = random.Random(6)
    values = [rng.uniform(1, 10) * 10.0 ** rng.randint(16, 300) for _ in range(2000)]
    got = results(column(spark, values, "double"), number_text("v"))
    assert [float(g) for g in got] == values
    assert all("e+" in g and "E" not in g for g in got)


def test_number_text_of_non_numbers(spark):
    values = [None, float("nan"), float("inf"), float("-inf")]
    assert results(column(spark, values, "double"), number_text("v")) == [None, None, "inf", "-inf"]


def test_bad_price(spark):
    values = [1.0, 1e-9, 0.0, -1.0, None, float("nan"), float("inf"), float("-inf")]
    got = results(column(spark, values, "double"), bad_price("v"))
    assert got == [False, False] + [True] * 6


def test_smape_term(spark):
    pairs = [(120.0, 100.0), (0.0, 0.0), (5.0, 0.0), (-5.0, 5.0), (7.0, 7.0)]
    df = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(pairs)], "i int, p double, a double")
    got = results(df, smape_term(F.col("p"), F.col("a")))
    assert got == [18.181818181818183, 0.0, 200.0, 200.0, 0.0]
