import math
import random

import pytest
from pyspark.sql import functions as F

from pricemill.operators.leaderboard import leaderboard, public_score, score_submissions
from pricemill.operators.predict import predict
from pricemill.operators.scoring import error_metrics, smape
from pricemill.operators.validation import check_submission, evaluate_submission
from pricemill.queries import _unit, products
from pricemill.schema import SUBMISSION_SCHEMA


def prices(spark, values):
    rows = list(values.items()) if isinstance(values, dict) else values
    return spark.createDataFrame(rows, SUBMISSION_SCHEMA)


def test_worked_example(spark):
    got = smape(prices(spark, {1: 120.0}), prices(spark, {1: 100.0})).first()
    assert (got.n_pairs, got.n_bad, got.smape) == (1, 0, 18.181818181818183)


def test_metrics_against_plain_python(spark):
    rng = random.Random(2)
    a = {i: rng.uniform(1, 500) for i in range(400)}
    p = {i: rng.uniform(1, 500) for i in range(400)}
    a[0] = p[0] = 0.0
    errors = [p[i] - a[i] for i in a]
    mean = sum(a.values()) / len(a)
    terms = [abs(p[i] - a[i]) / ((a[i] + p[i]) / 2) if a[i] + p[i] else 0 for i in a]
    expected = {
        "smape": 100 * sum(terms) / len(a),
        "mae": sum(map(abs, errors)) / len(a),
        "rmse": math.sqrt(sum(e * e for e in errors) / len(a)),
        "r2": 1 - sum(e * e for e in errors) / sum((v - mean) ** 2 for v in a.values()),
    }
    got = error_metrics(prices(spark, p), prices(spark, a)).first()
    for name, value in expected.items():
        assert math.isclose(got[name], value, rel_tol=1e-12), name


def test_r2_without_variance_is_null(spark):
    got = error_metrics(prices(spark, {1: 2.0, 2: 3.0}), prices(spark, {1: 5.0, 2: 5.0})).first()
    assert got.r2 is None and got.mae == 2.5


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_bad_predictions_are_never_averaged_away(spark, bad):
    got = error_metrics(
        prices(spark, {1: 2.0, 2: bad, 3: 9.0}), prices(spark, {1: 2.0, 2: 5.0})
    ).first()
    assert tuple(got) == (2, 1, 0, 1, 0, None, None, None, None)


def test_no_pairs(spark):
    got = error_metrics(prices(spark, {1: 2.0}), prices(spark, {2: 2.0})).first()
    assert tuple(got) == (0, 0, 1, 1, 0, None, None, None, None)


def test_values_on_the_part_table(spark, sf_dir):
    table = products(spark, sf_dir)
    got = error_metrics(predict(table), table).first()
    rounded = tuple(round(got[m], 6) for m in ("smape", "mae", "rmse", "r2"))
    assert rounded == (119.272375, 693.245055, 708.179785, -600.822932)


def faulty(table):
    """Missing, extra and repeated ids, and prices that are negative, NaN and missing."""
    rows = table.select("sample_id").filter("sample_id % 101 <> 0")
    extra = table.filter("sample_id % 500 = 0").select((-F.col("sample_id") - 1).alias("sample_id"))
    repeated = table.select("sample_id").filter("sample_id % 103 = 0 and sample_id % 101 <> 0")
    price = (
        F.when(F.col("sample_id") % 107 == 0, -1.0)
        .when(F.col("sample_id") % 107 == 1, float("nan"))
        .when(F.col("sample_id") % 107 == 2, F.lit(None))
        .otherwise(10.0)
    )
    return rows.union(extra).union(repeated).withColumn("price", price)


def test_every_fault_is_counted(spark, sf_dir):
    table = products(spark, sf_dir)
    got = check_submission(faulty(table), table).first()
    assert tuple(got) == (2000, 2003, 20, 4, 19, 56, 0, False)
    scored = evaluate_submission(faulty(table), table).first()
    assert tuple(scored)[:8] == tuple(got) and tuple(scored)[8:] == (None,) * 4


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 5.0), (2, 5.0)], (2, 2, 0, 0, 0, 0, True)),
        ([(1, 5.0)], (2, 1, 1, 0, 0, 0, False)),
        ([], (2, 0, 2, 0, 0, 0, False)),
        ([(1, 5.0), (2, 5.0), (3, 5.0)], (2, 3, 0, 1, 0, 0, False)),
        ([(1, 5.0), (2, 5.0), (2, 5.0)], (2, 3, 0, 0, 1, 0, False)),
        ([(1, 5.0), (2, 0.0)], (2, 2, 0, 0, 0, 1, False)),
        ([(1, 5.0), (2, -1.0)], (2, 2, 0, 0, 0, 1, False)),
        ([(1, 5.0), (2, None)], (2, 2, 0, 0, 0, 1, False)),
        ([(1, 5.0), (2, float("nan"))], (2, 2, 0, 0, 0, 1, False)),
        ([(1, 5.0), (2, float("inf"))], (2, 2, 0, 0, 0, 1, False)),
        ([(1, 5.0), (2, 5.0), (None, 5.0)], (2, 3, 0, 1, 0, 0, False)),
    ],
)
def test_check(spark, rows, expected):
    truth = prices(spark, {1: 4.0, 2: 6.0})
    expected = (*expected[:-1], 0, expected[-1])
    assert tuple(check_submission(prices(spark, rows), truth).first()) == expected
    scored = evaluate_submission(prices(spark, rows), truth).first()
    assert tuple(scored)[:8] == expected
    assert (scored.smape is not None) == expected[-1]


def test_bad_truth_is_not_scored(spark):
    got = evaluate_submission(prices(spark, {1: 5.0}), prices(spark, {1: None})).first()
    assert got.ok and got.smape is None


def orders_truth(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr("o_orderkey as sample_id", "o_totalprice as price")


def team_prices(truth, team):
    price = F.round(5 + 495 * _unit(F.lit(team), F.col("sample_id")), 2)
    return truth.select(F.lit(team).alias("submission_id"), "sample_id", price.alias("price"))


def test_public_ranks(spark, sf_dir):
    truth = orders_truth(spark, sf_dir)
    tables = team_prices(truth, 1)
    for team in (2, 3, 4, 5):
        tables = tables.unionByName(team_prices(truth, team))
    board = leaderboard(tables, truth, 500, 7).orderBy("submission_id").collect()
    assert [r.public_smape for r in board] == [
        198.543912, 198.624427, 198.646735, 198.594344, 198.523703,
    ]
    assert [r.public_rank for r in board] == [2, 4, 5, 3, 1]
    assert sorted(r.final_rank for r in board) == [1, 2, 3, 4, 5]
    scores = public_score(tables, truth, 500, 7).orderBy("submission_id").collect()
    assert [r.smape for r in scores] == [r.public_smape for r in board]
    assert {r.n_public for r in scores} == {500}


def test_ties_and_unscored_submissions(spark):
    truth = prices(spark, {i: 100.0 for i in range(10)})
    rows = [(name, i, price) for name, price in (("a", 90.0), ("b", 90.0), ("c", 80.0)) for i in range(10)]
    rows += [("short", i, 100.0) for i in range(9)]
    rows += [("wide", i, 100.0) for i in range(11)]
    rows += [("twice", i % 10, 100.0) for i in range(20)]
    rows += [("wrong", i, float(i)) for i in range(10)]
    table = spark.createDataFrame(rows, "submission_id string, sample_id bigint, price double")
    got = {r.submission_id: r for r in leaderboard(table, truth, 5).collect()}
    assert {k: r.final_rank for k, r in got.items()} == {
        "a": 1, "b": 1, "c": 3, "short": None, "wide": None, "twice": None, "wrong": None,
    }
    assert {k for k, r in got.items() if r.ok} == {"a", "b", "c"}
    assert got["a"].public_rank == 1 and got["c"].public_rank == 3
    assert got["short"].public_smape is None and got["short"].final_smape is None


def test_checks_agree_with_plain_python(spark):
    rng = random.Random(8)
    truth = {i: rng.uniform(1, 100) for i in range(60)}
    rows = []
    for name in range(30):
        ids = list(truth)
        if name % 2:
            ids = rng.sample(ids, rng.randint(50, 60)) + rng.choices(range(80), k=rng.randint(0, 5))
        bad = [0.0, -3.0, None, float("nan"), float("inf")]
        risk = 0.05 if name % 3 == 0 else 0
        rows += [
            (name, i, rng.choice(bad) if rng.random() < risk else rng.uniform(1, 100)) for i in ids
        ]
    table = spark.createDataFrame(rows, "submission_id int, sample_id bigint, price double")
    truth_table = prices(spark, truth)
    public = F.col("sample_id") < 20
    scored = {r.submission_id: r for r in score_submissions(table, truth_table, public).collect()}

    def smape_over(pairs, ids):
        return round(sum(100 * abs(pairs[i] - truth[i]) / ((pairs[i] + truth[i]) / 2) for i in ids) / len(ids), 6)

    n_ok = 0
    for name in range(30):
        mine = [(i, p) for s, i, p in rows if s == name]
        ids = [i for i, _ in mine]
        expected = (
            len(set(truth) - set(ids)),
            len(set(ids) - set(truth)),
            sum(ids.count(i) > 1 for i in set(ids)),
            sum(p is None or not math.isfinite(p) or p <= 0 for _, p in mine),
        )
        got = scored[name]
        assert (got.missing, got.extra, got.dup_ids, got.bad_price) == expected
        assert got.n_got == len(mine) and got.ok == (sum(expected) == 0)
        if got.ok:
            n_ok += 1
            pairs = dict(mine)
            assert got.final_smape == pytest.approx(smape_over(pairs, truth), abs=2e-6)
            assert got.public_smape == pytest.approx(smape_over(pairs, range(20)), abs=2e-6)
        else:
            assert got.final_smape is None and got.public_smape is None
    assert 0 < n_ok < 30
    one = table.filter("submission_id = 3").drop("submission_id")
    alone = check_submission(one, truth_table).first()
    same = scored[3]
    assert tuple(alone)[1:] == (same.n_got, same.missing, same.extra, same.dup_ids, same.bad_price, same.dup_truth, same.ok)


def test_repeated_truth_scores_nothing_anywhere(spark):
    truth = prices(spark, [(1, 10.0), (2, 20.0), (2, 999.0)])
    submission = prices(spark, [(1, 10.0), (2, 20.0)])
    row = evaluate_submission(submission, truth).first()
    assert (row.dup_truth, row.ok, row.smape) == (1, False, None)
    assert error_metrics(submission, truth).first()[4:] == (1, None, None, None, None)
    board = leaderboard(submission.withColumn("submission_id", F.lit("a")), truth, 1).first()
    assert (board.ok, board.final_smape, board.final_rank) == (False, None, None)


def test_incomplete_predictions_have_no_metrics(spark):
    got = error_metrics(prices(spark, {1: 2.0}), prices(spark, {1: 2.0, 2: 5.0})).first()
    assert tuple(got) == (1, 0, 1, 0, 0, None, None, None, None)
    got = error_metrics(prices(spark, [(1, 2.0), (1, 3.0)]), prices(spark, {1: 2.0})).first()
    assert tuple(got) == (1, 0, 0, 0, 1, None, None, None, None)


def test_a_listed_submission_without_rows_is_a_row(spark):
    truth = prices(spark, {1: 4.0, 2: 6.0})
    table = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 6.0)], "submission_id string, sample_id bigint, price double")
    listed = spark.createDataFrame([("a",), ("none",)], "submission_id string")
    got = {r.submission_id: r for r in score_submissions(table, truth, F.col("sample_id") < 2, listed).collect()}
    assert (got["none"].n_got, got["none"].missing, got["none"].ok, got["none"].final_smape) == (0, 2, False, None)
    assert got["a"].ok and got["a"].final_smape == 0
