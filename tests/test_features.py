"""Merged profiles, text weights, grouped holdouts, errors by segment and rank intervals on small fixtures."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricemill.functions.errors import smape_term
from pricemill.operators import tfidf
from pricemill.operators.groups import grouped_holdout, leaks, product_groups
from pricemill.operators.profile import DISTINCT_ERROR, merge_profiles, profile, read_profile, sketch_profile, write_profile
from pricemill.operators.segments import error_by_segment, leaderboard_bootstrap, poisson_of, price_band
from pricemill.operators.tfidf import TextVocabulary, fit_vocabulary
from pricemill.schema import TRAIN_SCHEMA


def test_profile_moves_no_texts(spark):
    rows = [(i, "long text " * 50 + str(i % 7), None if i % 3 else "link", float(i % 5)) for i in range(300)]
    table = spark.createDataFrame(rows, TRAIN_SCHEMA).repartition(4)
    plan = profile(table)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line and "SinglePartition" not in line:
            assert "catalog_content" not in line
    got = {r.column: r.n_distinct for r in profile(table).collect()}
    assert got == {"sample_id": 300, "catalog_content": 7, "image_link": 1, "price": 5}
    assert {r.n_distinct for r in profile(table.filter("false")).collect()} == {0}


def test_merged_profile_of_few_values_is_exact(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.randrange(50), draw.choice("abc"), None, draw.choice([1.5, 2.5, None, float("nan")])) for _ in range(400)]
    table = spark.createDataFrame(rows, TRAIN_SCHEMA)
    exact = {r.column: r for r in profile(table).collect()}
    for at in range(4):  # four loads, one after the other
        write_profile(table.filter(F.col("sample_id") % 4 == at), str(tmp_path / "stored"), "catalog_content")
    merged = {r.column: r for r in read_profile(spark, str(tmp_path / "stored")).collect()}
    assert set(merged) == {"sample_id", "image_link", "price"}
    for name, row in merged.items():
        assert tuple(row)[1:5] == tuple(exact[name])[1:5] and row.n_distinct == exact[name].n_distinct
    ids = sorted(r[0] for r in rows)
    assert (merged["sample_id"].low, merged["sample_id"].high) == (min(ids), max(ids))
    assert merged["price"].low == 1.5 and merged["price"].high == 2.5 and merged["image_link"].median is None


def test_merged_profile_of_many_values(spark):
    table = spark.range(200_000).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("part"))
    row = merge_profiles(sketch_profile(table, "part")).first()
    assert abs(row.n_distinct - 200_000) <= DISTINCT_ERROR * 200_000
    assert abs(row.median - 100_000) <= 0.02 * 200_000 and row.n_rows == 200_000
    sizes = sketch_profile(table, "part").select(F.length("distinct_sketch"), F.length("quantile_sketch")).collect()
    assert max(max(r) for r in sizes) < 20_000


TEXTS = [(1, "Red lamp, red!"), (2, "lamp"), (3, None), (4, ""), (5, "Blue LAMP 42"), (5, "blue lamp 42"), (None, "red"), (6, "?!")]


def test_weights_of_words(spark, tmp_path):
    table = spark.createDataFrame(TEXTS, "sample_id long, catalog_content string").repartition(3)
    fit_vocabulary(table).save(str(tmp_path / "v"))
    vocabulary = TextVocabulary.load(spark, str(tmp_path / "v"))
    words = {r.word: (r.n_docs, r.idx) for r in vocabulary.words.collect()}
    assert words == {"lamp": (4, 0), "42": (2, 1), "blue": (2, 2), "red": (2, 3)} and vocabulary.n_texts == 8
    got = sorted(((r.sample_id, r.indices, [round(v, 9) for v in r["values"]]) for r in vocabulary.vectors(table).collect()), key=repr)
    want = []
    for name, text in TEXTS:
        counts = Counter(re.findall("[a-z0-9]+", (text or "").lower()))
        entries = sorted((words[w][1], round(n * math.log(9 / (words[w][0] + 1)), 9)) for w, n in counts.items())
        want.append((name, [i for i, _ in entries], [v for _, v in entries]))
    assert got == sorted(want, key=repr)
    fewer = fit_vocabulary(table, min_docs=3)
    assert [r.word for r in fewer.words.collect()] == ["lamp"]
    other = spark.createDataFrame([(9, "green lamp lamp")], "sample_id long, catalog_content string")
    assert [(r.indices, r["values"]) for r in fewer.vectors(other).collect()] == [([0], [pytest.approx(2 * math.log(9 / 5))])]


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_weights_do_not_depend_on_how_many_words_are_frequent(spark, monkeypatch, frequent):
    """Only words after the frequent ones are left for the join by word; the others have their weight in the text's task."""
    monkeypatch.setattr(tfidf, "FREQUENT", frequent)
    monkeypatch.setattr(tfidf, "_HELD", 4)
    monkeypatch.setattr(tfidf, "_ROWS", 3)
    texts = [" ".join(f"w{j}" for j in range(i % 9)) + f" all {'ALL ' * (i % 4)}\u212a\u0130x no{i % 7}" for i in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "sample_id long, catalog_content string").repartition(3)
    counted = [Counter(re.findall("[a-z0-9]+", text.lower())) for text in texts]
    n_docs = Counter(word for words in counted for word in words)
    idx = {word: i for i, word in enumerate(sorted(n_docs, key=lambda word: (-n_docs[word], word)))}
    vocabulary = fit_vocabulary(table)
    assert {r.word: (r.n_docs, r.idx) for r in vocabulary.words.collect()} == {w: (n, idx[w]) for w, n in n_docs.items()}
    vectors = vocabulary.vectors(table)
    for row in vectors.collect():
        want = sorted((idx[w], n * math.log(41 / (n_docs[w] + 1))) for w, n in counted[row.sample_id].items())
        assert row.indices == [i for i, _ in want] and row["values"] == pytest.approx([v for _, v in want])
    settled = [path for path in vectors.inputFiles() if "/text-words-" in path]
    by_word = spark.read.parquet(*settled).select(F.explode("words").alias("word")).distinct().collect()
    assert {r.word for r in by_word} == {word for word, i in idx.items() if i >= frequent}
    assert vectors.count() == 40


def test_no_texts_have_no_vocabulary(spark, tmp_path):
    empty = spark.createDataFrame([], "sample_id long, catalog_content string")
    fit_vocabulary(empty).save(str(tmp_path / "v"))
    vocabulary = TextVocabulary.load(spark, str(tmp_path / "v"))
    assert vocabulary.n_texts == 0 and vocabulary.words.count() == 0 and vocabulary.vectors(empty).collect() == []


PRODUCTS = "sample_id long, catalog_content string, image_link string"


def plain_groups(rows):
    """Smallest id of each id's component, by walking."""
    keys = {}
    for name, text, link in rows:
        if name is not None:
            normal = re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()
            for key in (("t", normal), ("l", (link or "").strip())):
                if key[1]:
                    keys.setdefault(key, set()).add(name)
    left, out = {r[0] for r in rows if r[0] is not None}, {}
    while left:
        seen, front = set(), {min(left)}
        while front:
            seen |= front
            front = {n for members in keys.values() if members & front for n in members} - seen
        out.update(dict.fromkeys(seen, min(seen)))
        left -= seen
    return out


def test_groups_of_random_products(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(300), f"text {draw.randrange(250)}", draw.choice([None, "", f"l{draw.randrange(400)}"])) for _ in range(320)]
    rows += [(None, "text 1", "l1"), (900, None, None), (901, " ?! ", " "), (902, "TEXT--1", None), (-5, "text 1!", None)]
    table = spark.createDataFrame(rows, PRODUCTS).repartition(3).withColumn("group_key", F.lit(1))
    assert {r.sample_id: r.group for r in product_groups(table).collect()} == plain_groups(rows)
    split = grouped_holdout(table, 0.3)
    assert split.count() == len(rows)
    assert all(r.n_keys == 0 for r in leaks(split.filter("sample_id is not null")).collect())
    held = {r.group for r in split.filter("holdout").collect()}
    groups = set(plain_groups(rows).values())
    assert 0.15 * len(groups) < len(held) < 0.45 * len(groups)
    assert split.filter("sample_id is null").first().holdout is False


def test_long_chains_and_hot_keys(spark):
    chain = [(i, f"t{i // 2}", f"l{(i + 1) // 2}") for i in range(1, 400)]
    hot = [(1000 + i, f"own {i}", "hot") for i in range(2000)]
    groups = {r.sample_id: r.group for r in product_groups(spark.createDataFrame(chain + hot, PRODUCTS)).collect()}
    assert {groups[i] for i in range(1, 400)} == {1} and {groups[1000 + i] for i in range(2000)} == {1000}
    assert product_groups(spark.createDataFrame([], PRODUCTS)).collect() == []


def test_bands(spark):
    prices = [None, float("nan"), -1.0, 0.0, 9.99, 10.0, 24.999, 25.0, 2000.0, float("inf")]
    table = spark.createDataFrame([(p,) for p in prices], "price double")
    got = [r[0] for r in table.select(price_band("price")).collect()]
    assert got == [None, None, "under 10", "under 10", "under 10", "10-25", "10-25", "25-50", "2000 and over", "2000 and over"]
    with pytest.raises(ValueError):
        price_band("price", [2, 1])


def test_errors_of_segments(spark):
    truth = spark.createDataFrame(
        [(1, 10.0, "x"), (2, 20.0, "x"), (3, 30.0, None), (4, None, "y"), (5, 12.0, "y"), (5, 12.0, "y")], "sample_id long, price double, brand string"
    )
    predictions = spark.createDataFrame([(1, 20.0), (2, 20.0), (3, float("nan")), (5, 6.0), (5, 9.0), (77, 1.0)], "sample_id long, price double")
    rows = {(r.band, r.brand, r.grouping): r for r in error_by_segment(predictions, truth, ["brand"]).collect()}
    whole = rows[None, None, 3]
    assert (whole.n_truth, whole.n_scored) == (5, 3) and whole.mae == pytest.approx(13 / 3)
    assert rows["10-25", "x", 0].n_scored == 2 and rows["10-25", None, 1].n_truth == 3
    assert (rows[None, None, 2].n_truth, rows[None, None, 2].mae) == (1, None)  # the null brand, not the total
    assert rows[None, "x", 2].mae == 5 and rows[None, "y", 0].n_truth == 1 and rows["25-50", None, 0].n_scored == 0
    assert rows[None, "x", 2].rmse == pytest.approx(math.sqrt(50))


def test_draws_have_the_chances_of_poisson(spark):
    counts = Counter(r[0] for r in spark.range(65536).select(poisson_of(F.col("id").cast("int"))).collect())
    for k in range(6):
        assert counts[k] == pytest.approx(65536 * math.exp(-1) / math.factorial(k), abs=1.01)
    assert sum(k * n for k, n in counts.items()) == pytest.approx(65536, abs=10)


def test_rank_intervals(spark):
    draw = random.Random(2)
    truth = [(i, 100.0) for i in range(200)] + [(500, None)]
    noise = {"best": 1.0, "near": 1.0, "worst": 60.0}
    rows = [(name, i, 100.0 + draw.uniform(-size, size)) for name, size in noise.items() for i, _ in truth]
    rows += [("none", 1, float("nan")), ("none", 999, 5.0)]
    submissions = spark.createDataFrame(rows, "submission_id string, sample_id long, price double")
    truth = spark.createDataFrame(truth, "sample_id long, price double")
    got = {r.submission_id: r for r in leaderboard_bootstrap(submissions, truth, 30).collect()}
    assert set(got) == set(noise) and {r.n_scored for r in got.values()} == {200}
    assert (got["worst"].rank, got["worst"].low_rank, got["worst"].high_rank, got["worst"].first_share) == (3, 3, 3, 0.0)
    assert got["best"].first_share + got["near"].first_share == pytest.approx(1)
    again = {r.submission_id: r for r in leaderboard_bootstrap(submissions.repartition(5), truth, 30).collect()}
    assert again == got
    pairs = submissions.join(truth.withColumnRenamed("price", "a"), "sample_id").filter("submission_id = 'worst' and a is not null")
    assert got["worst"].smape == pytest.approx(pairs.agg(F.avg(smape_term(F.col("price"), F.col("a")))).first()[0], abs=1e-6)
