"""Choosing a ridge value by folds, and weights of several models by least squares, from Gram matrices."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.functions.errors import smape_of
from pricemill.functions.hashing import unit_hash
from pricemill.schema import SAMPLE_SEED
from pricemill.sources.staging import staged

RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0)
FOLDS = 5
# Features of a model: the driver holds this many squared numbers per fold, whatever the rows.
MAX_FEATURES = 512


def fold_of(key: str | list[str], folds: int = FOLDS, seed=SAMPLE_SEED) -> Column:
    """A fold from 0 by a hash of the key alone: rows that share a key share a fold."""
    return F.floor(unit_hash(seed, *([key] if isinstance(key, str) else key)) * folds).cast("int")


def _gram_rows(n: int):
    """Per batch and fold the sums of products of features and target, as one row of numbers."""

    def add(batches):
        import pandas as pd

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = np.stack(batch["z"].to_numpy()) if len(batch) else np.zeros((0, n))
            folds = batch["fold"].to_numpy()
            for fold in np.unique(folds):
                part = rows[folds == fold]
                sums[int(fold)] = sums.get(int(fold), 0) + part.T @ part
        out = [(fold, i, m[i].tolist()) for fold, m in sums.items() for i in range(n)]
        yield pd.DataFrame(out, columns=["fold", "i", "row"])

    return add


def gram_per_fold(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Sum of z z' per fold of rows (fold, z array of n numbers).

    A task adds up its rows and sends n numbers for each of n lines per fold, whatever it has read; Spark adds
    the lines up, and folds times n squared numbers reach the driver.
    """
    if n > MAX_FEATURES + 1:
        raise ValueError(f"{n} columns are more than {MAX_FEATURES + 1}")
    partial = rows.select("fold", "z").mapInPandas(_gram_rows(n), "fold int, i int, row array<double>")
    summed = partial.select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    lines = summed.groupBy("fold", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("line"))
    out: dict[int, np.ndarray] = {}
    for line in lines.select("fold", "i", F.col("line.v").alias("line")).collect():
        out.setdefault(line.fold, np.zeros((n, n)))[line.i] = line.line
    return out


def ridge_solution(gram: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the last column on the others; the constant, the last but one, is not shrunk."""
    x, y = gram[:-1, :-1], gram[:-1, -1]
    shrink = np.full(len(x), ridge)
    shrink[-1] = 1e-9
    return np.linalg.solve(x + np.diag(shrink), y)


@dataclass
class LinearPrices:
    """log price = weights . features, features by name of a column of expressions."""

    weights: list[float]
    features: list[str]
    ridge: float

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, f, float(w), float(self.ridge)) for i, (f, w) in enumerate(zip(self.features, self.weights))]
        spark.createDataFrame(rows, "i int, feature string, weight double, ridge double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearPrices":
        """A stored model has one row per feature, ``MAX_FEATURES`` at most."""
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.i)
        return LinearPrices([r.weight for r in rows], [r.feature for r in rows], rows[0].ridge)

    def price(self) -> Column:
        terms = [F.lit(w) * F.expr(f) for w, f in zip(self.weights, self.features)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return F.exp(total)

    def predict(self, products: DataFrame) -> DataFrame:
        return products.select("sample_id", self.price().alias("price"))


def cross_validate(
    products: DataFrame,
    features: Sequence[str],
    folds: int = FOLDS,
    ridges: Sequence[float] = RIDGES,
    key: str = "sample_id",
    seed=SAMPLE_SEED,
) -> tuple[LinearPrices, DataFrame]:
    """(the best model, fitted on all rows; scores ``fold, ridge, n_rows, smape, baseline_smape``).

    ``features`` are SQL expressions of the columns, all of them numbers; a constant is added. Rows without a
    positive finite price, or with a feature that is no number, are left out. One pass adds up the Gram matrix of each fold; the
    matrices without a fold give the weights of that fold for every ridge value without reading a row again.
    A second pass scores all ridge values of all folds at once. ``baseline_smape`` is that of the geometric mean
    price of the other folds, known from the same matrices: a model that does not beat it has learnt nothing.
    The ridge with the lowest mean SMAPE wins, of equal ones the largest.
    """
    names = [*features, "1.0D"]
    usable = (F.col("price") > 0) & (F.col("price") < float("inf"))
    values = [F.expr(f).cast("double") for f in names]
    rows = products.filter(usable).select(
        fold_of(key, folds, seed).alias("fold"), F.col("price"), F.array(*values, F.log("price")).alias("z")
    )
    rows = staged(rows.filter(~F.exists("z", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))), "fold-rows")
    n = len(names) + 1
    grams = gram_per_fold(rows, n)
    if len(grams) < 2:
        raise ValueError("there are too few rows for two folds")
    whole = sum(grams.values())
    trained = {(f, r): ridge_solution(whole - g, r) for f, g in grams.items() for r in ridges}
    # The constant's products are the rows and the sum of the logarithms.
    means = {f: float(np.exp((whole - g)[-2, -1] / (whole - g)[-2, -2])) for f, g in grams.items()}
    spark = products.sparkSession
    models = spark.createDataFrame(
        [(f, float(r), w.tolist(), means[f]) for (f, r), w in trained.items()], "fold int, ridge double, w array<double>, mean double"
    )
    paired = rows.join(F.broadcast(models), "fold")  # folds times ridge values rows
    product = F.aggregate(F.zip_with("w", F.slice("z", 1, n - 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scores = paired.groupBy("fold", "ridge").agg(
        F.count("*").alias("n_rows"),
        smape_of(F.exp(product), F.col("price")).alias("smape"),
        smape_of(F.col("mean"), F.col("price")).alias("baseline_smape"),
    )
    scores = staged(scores, "fold-scores")
    best = scores.groupBy("ridge").agg(F.avg("smape").alias("s")).orderBy(F.round("s", 9), F.col("ridge").desc()).first()
    model = LinearPrices(ridge_solution(whole, best.ridge).tolist(), names, best.ridge)
    return model, scores


def non_negative_weights(gram: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the last column on the others (Lawson and Hanson's active set), from z z' alone."""
    a, b = gram[:-1, :-1], gram[:-1, -1]
    n = len(b)
    weights, held = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(3 * n + 10):
        slope = b - a @ weights
        free = np.flatnonzero(~held & (slope > 1e-10 * scale))
        if not len(free):
            break
        held[free[np.argmax(slope[free])]] = True
        while True:
            step = np.zeros(n)
            step[held] = np.linalg.lstsq(a[np.ix_(held, held)], b[held], rcond=None)[0]
            if not (step[held] <= 0).any():
                weights = step
                break
            low = held & (step <= 0)
            share = (weights[low] / (weights[low] - step[low])).min()
            weights = weights + share * (step - weights)
            held &= weights > 1e-14
            weights[~held] = 0.0
    return weights


def stack_weights(members: dict[str, DataFrame], truth: DataFrame) -> dict[str, float]:
    """Weights of the members that fit the true prices best, none below zero, by least squares.

    Only ids that the truth and every member have a finite price for count; an id that is repeated counts with
    the mean of its prices. Members and truth are one table, grouped by id once; the Gram matrix of the pairs
    is one aggregate, and its members times members numbers are all that the driver sees.
    """
    names = list(members)
    tables = [t.select("sample_id", "price", F.lit(i).alias("m")) for i, t in enumerate([*members.values(), truth])]
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    good = F.col("price").isNotNull() & ~F.isnan("price") & (F.abs("price") < float("inf"))
    columns = [F.avg(F.when(good & (F.col("m") == i), F.col("price"))).alias(f"c{i}") for i in range(len(tables))]
    wide = rows.groupBy("sample_id").agg(*columns).dropna(subset=[f"c{i}" for i in range(len(tables))])
    n = len(tables)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    sums = wide.agg(F.count("*").alias("n"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in cells]).first()
    if not sums.n:
        raise ValueError("no id has a price from every member and the truth")
    gram = np.zeros((n, n))
    for i, j in cells:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"]
    return dict(zip(names, non_negative_weights(gram).tolist()))


def stacked(members: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """``sample_id, price, n_members``: the weighted sum of the members' prices, over the ids that all members
    with a weight above zero have a price for; an id that one of them lacks has a null price."""
    used = {name: weight for name, weight in weights.items() if weight > 0}
    tables = [members[name].select("sample_id", "price", F.lit(name).alias("m"), F.lit(weight).alias("w")) for name, weight in used.items()]
    if not tables:
        raise ValueError("no member has a weight above zero")
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    good = F.col("price").isNotNull() & ~F.isnan("price")
    each = rows.groupBy("sample_id", "m", "w").agg(F.avg(F.when(good, F.col("price"))).alias("price"))
    sums = each.groupBy("sample_id").agg(F.sum(F.col("w") * F.col("price")).alias("price"), F.count("price").alias("n_members"))
    return sums.withColumn("price", F.when(F.col("n_members") == len(used), F.col("price")))
