import random

import pytest
from pyspark.sql import functions as F

from pricemill.operators import catalog, profile
from pricemill.operators.model import fit_price_model, text_features
from pricemill.schema import TRAIN_SCHEMA


def products(spark, rows):
    return spark.createDataFrame(rows, TRAIN_SCHEMA)


def test_holdout_depends_on_the_key_alone(spark):
    table = spark.range(4000).select(F.col("id").alias("sample_id"))
    chosen = {r[0] for r in table.filter(catalog.in_holdout(share=0.2)).collect()}
    assert 650 < len(chosen) < 950
    again = table.filter("sample_id < 1000").repartition(3).filter(catalog.in_holdout(share=0.2))
    assert {r[0] for r in again.collect()} == {i for i in chosen if i < 1000}
    assert table.filter(catalog.in_holdout(share=0)).count() == 0
    assert table.filter(catalog.in_holdout(share=1)).count() == 4000
    with pytest.raises(ValueError):
        catalog.in_holdout(share=1.5)


def test_clean(spark):
    rows = [(1, " a \n b ", "x", 2.0), (1, "a b", None, 3.0), (2, "  ", "x", 1.0), (3, None, "x", 1.0), (None, "a", "x", 1.0),
            (4, "c", "x", -1.0), (5, "c", "x", None), (6, "c", "x", float("nan")), (7, "c", None, 9.5), (7, "c", None, 9.5)]
    got = catalog.clean(products(spark, rows))
    assert got.columns == TRAIN_SCHEMA.names
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b", None, 3.0), (7, "c", None, 9.5)]


@pytest.mark.parametrize("parts", [1, 4])
def test_fences_and_flags(spark, parts):
    rng = random.Random(1)
    prices = [round(rng.lognormvariate(3, 1), 2) for _ in range(1001)] + [None, float("nan"), 5000.0]
    table = products(spark, [(i, "t", None, p) for i, p in enumerate(prices)]).repartition(parts)
    real = sorted(p for p in prices if p is not None and p == p)
    n = len(real)
    q1, q3 = real[-(-n // 4) - 1], real[-(-3 * n // 4) - 1]
    got = catalog.price_fences(table).first()
    assert (got.q1, got.q3) == (q1, q3)
    flags = {r.sample_id: r.outlier for r in catalog.flag_outliers(table).collect()}
    for i, p in enumerate(prices):
        want = None if p is None or p != p else p < q1 - 1.5 * (q3 - q1) or p > q3 + 1.5 * (q3 - q1)
        assert flags[i] == want
    none = catalog.price_fences(table.filter("price is null")).first()
    assert tuple(none) == (None, None, None, None)


def test_ensemble_shows_missing_members(spark):
    def member(rows):
        return spark.createDataFrame(rows, "sample_id long, price double")

    members = {
        "a": (member([(1, 10.0), (2, 20.0), (2, 40.0)]), 3.0),
        "b": (member([(1, 20.0), (3, float("nan"))]), 1.0),
    }
    got = {r.sample_id: tuple(r)[1:] for r in catalog.ensemble(members).collect()}
    assert got == {1: (12.5, 2, 0.0), 2: (30.0, 1, 1.0), 3: (None, 0, 4.0)}
    with pytest.raises(ValueError):
        catalog.ensemble({"a": (member([(1, 1.0)]), 0.0)})


def test_pack_quantity(spark):
    texts = ["soap pack of 12", "Pack Of 3 or pack of 9", "a pack of", None, "pack of 99999999999999999999"]
    table = spark.createDataFrame([(t,) for t in texts], "catalog_content string").coalesce(1)
    assert [r[0] for r in table.select(catalog.pack_quantity()).collect()] == [12, 3, None, None, None]


def test_profile(spark):
    rows = [(1, "ab", None, 1.0), (2, "", "x", 1.0), (3, None, "x", None)]
    got = {r.column: tuple(r)[1:] for r in profile.profile(products(spark, rows)).collect()}
    assert got == {
        "sample_id": (3, 0, None, None, 3), "catalog_content": (3, 1, 0, 2, 2),
        "image_link": (3, 1, 1, 1, 1), "price": (3, 1, None, None, 1),
    }


def test_text_features(spark):
    rows = [(1, "red soap soap", None, 1.0), (2, None, None, 1.0), (3, "blue soap", None, 1.0)]
    got = {r.sample_id: r.features for r in text_features(products(spark, rows), 64).collect()}
    assert got[2].numNonzeros() == 0 and got[1].size == 64
    assert got[1].numNonzeros() == 2 and got[1].norm(1) != got[3].norm(1)


def test_a_model_must_beat_the_median(spark):
    rng = random.Random(4)
    kinds = {"soap": 5.0, "lamp": 40.0, "chair": 120.0}
    rows = [(i, f"{k} item {rng.randrange(9)}", None, kinds[k] * rng.uniform(0.9, 1.1)) for i, k in enumerate(rng.choices(list(kinds), k=400))]
    table = products(spark, rows)
    held = catalog.in_holdout()
    model = fit_price_model(table.filter(~held), table.filter(held))
    assert model.accepted and model.model_smape < 20 < model.median_smape
    got = {r.sample_id: r.price for r in model.predict(table).collect()}
    assert len(got) == 400 and all(abs(got[i] / p - 1) < 0.6 for i, _, _, p in rows)
    noise = products(spark, [(i, "same", None, rng.uniform(1, 2)) for i in range(200)])
    model = fit_price_model(noise.filter(~held), noise.filter(held))
    prices = {r.price for r in model.predict(noise).collect()}
    assert len(prices) == 1
    with pytest.raises(ValueError):
        fit_price_model(noise.filter("false"), noise)
