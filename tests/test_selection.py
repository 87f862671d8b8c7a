"""Ridge values by folds, non-negative weights and throttled fetching against plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.operators.images import FolderStore, fetch_images
from pricemill.operators.selection import LinearPrices, cross_validate, fold_of, gram_per_fold, non_negative_weights, stack_weights, stacked
from pricemill.operators.throttle import Clock, Refused, Throttle, _fetched, dealt_by_host, fetch_throttled, link_host


def test_gram_matrices_per_fold(spark):
    draw = np.random.default_rng(1)
    z, folds = draw.normal(size=(500, 4)), draw.integers(0, 3, 500)
    rows = spark.createDataFrame([(int(f), v.tolist()) for f, v in zip(folds, z)], "fold int, z array<double>").repartition(4)
    got = gram_per_fold(rows, 4)
    for fold in range(3):
        np.testing.assert_allclose(got[fold], z[folds == fold].T @ z[folds == fold], rtol=1e-12)


def prices(n, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = draw.uniform(-1, 1), draw.uniform(-1, 1)
        rows.append((i, x, y, math.exp(2 + 1.5 * x - 0.5 * y + draw.gauss(0, 0.05))))
    return rows


def test_folds_find_the_model_that_made_the_prices(spark, tmp_path):
    rows = prices(800) + [(9000, 1.0, 1.0, None), (9001, None, 1.0, 3.0), (9002, 1.0, 1.0, -1.0), (9003, float("nan"), 1.0, 2.0)]
    table = spark.createDataFrame(rows, "sample_id long, x double, y double, price double").repartition(3)
    model, scores = cross_validate(table, ["x", "y"])
    scores = scores.collect()
    assert len(scores) == 25 and sum(r.n_rows for r in scores) == 5 * 800
    assert model.weights == pytest.approx([1.5, -0.5, 2.0], abs=0.02) and model.ridge < 10
    assert all(r.smape < 6 < r.baseline_smape for r in scores if r.ridge == model.ridge)
    # One fold by hand: fitted on the others, scored on its rows.
    folds = {r.sample_id: r.f for r in table.select("sample_id", fold_of("sample_id").alias("f")).collect()}
    whole = prices(800)
    train = np.array([[x, y, 1.0, math.log(p)] for i, x, y, p in whole if folds[i] != 2])
    a = train[:, :3].T @ train[:, :3] + np.diag([1.0, 1.0, 1e-9])
    w = np.linalg.solve(a, train[:, :3].T @ train[:, 3])
    mean = math.exp(train[:, 3].mean())
    held = [(math.exp(w @ [x, y, 1.0]), p) for i, x, y, p in whole if folds[i] == 2]
    want = np.mean([100 * abs(a - b) / ((a + b) / 2) for a, b in held])
    got = next(r for r in scores if r.fold == 2 and r.ridge == 1.0)
    assert got.smape == pytest.approx(want) and got.n_rows == len(held)
    assert got.baseline_smape == pytest.approx(np.mean([100 * abs(mean - p) / ((mean + p) / 2) for _, p in held]))
    model.save(spark, str(tmp_path / "m"))
    again = LinearPrices.load(spark, str(tmp_path / "m"))
    assert again == model
    first = again.predict(table.filter("sample_id = 5")).first().price
    assert first == pytest.approx(math.exp(np.dot(model.weights, [whole[5][1], whole[5][2], 1.0])))


def test_too_few_rows_for_folds(spark):
    with pytest.raises(ValueError):
        cross_validate(spark.createDataFrame([(1, 1.0, 2.0)], "sample_id long, x double, price double"), ["x"])


@pytest.mark.parametrize("seed", range(12))
def test_non_negative_least_squares_meets_its_conditions(seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(60, 6))
    y = x @ draw.normal(size=6) + draw.normal(size=60)
    z = np.column_stack([x, y])
    w = non_negative_weights(z.T @ z)
    slope = x.T @ (y - x @ w)
    assert (w >= 0).all() and (slope <= 1e-6).all() and abs(slope @ w) < 1e-6


def test_stack(spark):
    draw = random.Random(6)
    truth = {i: draw.uniform(10, 100) for i in range(300)}
    made = {
        "low": {i: 0.5 * p for i, p in truth.items()},
        "noise": {i: draw.uniform(10, 100) for i in truth},
        "against": {i: -p for i, p in truth.items()},
    }
    members = {m: spark.createDataFrame([*v.items(), (1, v[1])], "sample_id long, price double") for m, v in made.items()}
    members["low"] = members["low"].filter("sample_id != 7")
    table = spark.createDataFrame([*truth.items(), (900, 5.0), (901, float("nan"))], "sample_id long, price double")
    weights = stack_weights(members, table)
    assert weights["low"] == pytest.approx(2, abs=1e-9) and weights["noise"] == pytest.approx(0, abs=1e-9) and weights["against"] == 0
    got = {r.sample_id: r.price for r in stacked(members, {"low": 2.0, "noise": 0.0, "against": 0.0}).collect()}
    assert 7 not in got and got[3] == pytest.approx(truth[3])
    with pytest.raises(ValueError):
        stack_weights(members, table.filter("sample_id > 800"))
    with pytest.raises(ValueError):
        stacked(members, {"low": 0.0})


class Time:
    def __init__(self):
        self.time, self.slept = 0.0, []

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.time += seconds


class Memory:
    def __init__(self, there=()):
        self.files = dict.fromkeys(there, b"old")

    def size(self, path):
        return len(self.files[path]) if path in self.files else None

    def save(self, path, content):
        self.files[path] = content


def run(urls, fetch, lanes=1, there=(), **how):
    time, calls = Time(), []

    def fetcher(url):
        calls.append((round(time.now(), 6), url))
        return fetch(url, [u for _, u in calls].count(url))

    rows = [(u, u, u, u.split("/")[2], 0, lanes) for u in urls]
    throttle = Throttle(clock=Clock(time.now, time.sleep), **how)
    return list(_fetched(rows, fetcher, Memory(there), throttle)), calls, time


def test_a_host_is_asked_at_its_rate():
    urls = [f"http://a/{i}" for i in range(6)] + ["http://b/0"]
    done, calls, time = run(urls, lambda u, n: b"x", rate=2)
    assert [c[0] for c in calls if "/a/" in c[1]] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    assert next(c[0] for c in calls if "/b/" in c[1]) == 0.0  # another host does not wait
    assert {d[3] for d in done} == {"ok"} and time.now() == 2.5
    shared = run(urls[:4], lambda u, n: b"x", lanes=4, rate=2)[1]
    assert [c[0] for c in shared] == [0.0, 2.0, 4.0, 6.0]


def test_refused_links_are_tried_again_with_growing_waits():
    def fetch(url, n):
        if url.endswith("bad") or n < 3:
            raise Refused()
        return b"abc"

    done, calls, _ = run(["http://a/1"], fetch, rate=100, first_wait=1, growth=3, attempts=4)
    assert [c[0] for c in calls] == [0.0, 1.0, 4.0] and done[0][3:6] == ("ok", 3, None) and done[0][7] == 3
    done, calls, _ = run(["http://a/bad"], fetch, rate=100, first_wait=1, growth=3, attempts=4, longest_wait=5)
    assert [c[0] for c in calls] == [0.0, 1.0, 4.0, 9.0]
    assert done[0][3] == "error" and done[0][5] == "Refused: refused" and done[0][7] == 4


def test_the_wait_that_a_host_asks_for_and_lost_links():
    def fetch(url, n):
        if "lost" in url:
            raise ValueError("gone")
        if n == 1:
            raise Refused(after=30)
        return b"x"

    done, calls, _ = run(["http://a/1", "http://b/lost"], fetch)
    assert [c[0] for c in calls if "/a/" in c[1]] == [0.0, 30.0]
    assert next(d for d in done if "lost" in d[0])[3:8] == ("error", None, "ValueError: gone", "b", 1)


def test_files_that_are_there_cost_nothing():
    urls = [f"http://a/{i}" for i in range(50)]
    done, calls, time = run(urls, lambda u, n: b"x", there=urls, rate=1)
    assert not calls and time.now() == 0 and len(done) == 50


def test_wrong_throttles():
    for wrong in ({"rate": 0}, {"attempts": 0}, {"growth": 0.5}, {"first_wait": -1}):
        with pytest.raises(ValueError):
            Throttle(**wrong)


def test_hosts_of_links(spark):
    links = ["http://A.b:80/x", "https://u:p@c.d?x@y", "no link", None, "ftp://e#f"]
    rows = spark.createDataFrame([(u,) for u in links], "url string").select(link_host("url")).collect()
    assert [r[0] for r in rows] == ["a.b:80", "c.d", "", "", "e"]


def test_hot_hosts_are_split_and_everything_is_fetched(spark, tmp_path):
    urls = [f"http://hot/{i}" for i in range(300)] + [f"http://h{i % 7}/{i}" for i in range(40)]
    rows = [(f"f{zlib.crc32(u.encode())}", u, str(tmp_path / f"f{zlib.crc32(u.encode())}")) for u in urls]
    pending = spark.createDataFrame(rows, "filename string, url string, path string")
    dealt = dealt_by_host(pending, 8).groupBy("host").agg(F.max("lanes").alias("n"), F.countDistinct("lane").alias("used")).collect()
    assert {r.host: (r.n, r.used) for r in dealt if r.host == "hot"} == {"hot": (8, 8)}
    assert all(r.n == 1 for r in dealt if r.host != "hot")
    held = {"t": 0.0}  # goes to the workers by value
    clock = Clock(lambda: held["t"], lambda seconds: held.update(t=held["t"] + seconds))
    log = fetch_throttled(pending, lambda url: url.encode(), FolderStore(), Throttle(rate=100, clock=clock), 8).collect()
    assert len(log) == 340 and {r.status for r in log} == {"ok"} and {r.attempts for r in log} == {1}
    again = fetch_images(pending, lambda url: 1 / 0, FolderStore(), 2).collect()
    assert {r.status for r in again} == {"ok"}
