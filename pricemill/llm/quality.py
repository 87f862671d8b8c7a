"""Quality scores learned from trusted positives and unlabelled text by non-negative unbiased risk."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the training sample: trusted positives, unlabelled texts.
MAX_POSITIVES = 6000
MAX_UNLABELLED = 12000
_KNOTS = 7
_STEPS = 600
_RATE = 0.05
_RIDGE = 1e-3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"
_PAUSES = b".,;:"

FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "marks", "pauses", "beyond_ascii", "distinct", "neighbours",
    "repeats", "top_word", "equal_lines", "line_words", "short_lines", "all_caps", "ends_in_symbol", "longest_word",
)


def features(text: str | None) -> list[float]:
    """Numbers that describe the form of a whole text, not its language or words; empty text has its own."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))

    def share(signs: bytes) -> float:
        return (len(data) - len(data.translate(None, signs))) / size

    counts = Counter(words)
    triples = list(zip(words, words[1:], words[2:]))
    lines = [line for line in data.split(b"\n") if line.strip()]
    ends = sum(1 for w in words if w[-1] in b"#*$%&|<>!")
    return [
        float(np.log1p(n)),
        size / n,
        share(_UPPER),
        share(_DIGITS),
        share(_SYMBOLS),
        share(_MARKS),
        share(_PAUSES),
        1 - share(_UPPER) - share(_LOWER) - share(_DIGITS),
        len(counts) / n**0.9,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(1 for line in lines if len(line) < 40) / len(lines),
        sum(map(bytes.isupper, words)) / n,
        ends / n,
        float(np.log1p(max(map(len, words)))),
    ]


def _knots(values: np.ndarray) -> np.ndarray:
    """Ascending places per feature, from the quantiles of the training sample."""
    quantiles = np.quantile(values, np.linspace(0, 1, _KNOTS), axis=0).T
    return quantiles + np.arange(_KNOTS) * 1e-9


def _basis(values: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Piecewise linear hats over the knots of each feature, and a constant."""
    columns = [np.ones((len(values), 1))]
    for j, places in enumerate(knots):
        at = np.clip(values[:, j], places[0], places[-1])
        columns.append(np.column_stack([np.interp(at, places, unit) for unit in np.eye(len(places))]))
    return np.hstack(columns)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with logistic loss, by Adam.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): while the second part is negative, the
    step climbs out of it instead of fitting the unlabelled texts further. A ridge keeps weights small.
    """
    weights = np.zeros(positives.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, _STEPS + 1):
        p, u = positives @ weights, unlabelled @ weights
        as_negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        slope = unlabelled.T @ _sigmoid(u) / len(u) - prior * (positives.T @ _sigmoid(p)) / len(p)
        if as_negative < 0:
            gradient = -slope
        else:
            gradient = slope - prior * (positives.T @ _sigmoid(-p)) / len(p)
        gradient += _RIDGE * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights = weights - _RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(knots, weights) from raw features. Without both kinds of rows the score is the prior for all."""
    if not len(positives) or not len(unlabelled):
        knots = _knots(np.zeros((1, len(FEATURES))))
        weights = np.zeros(1 + knots.size)
        weights[0] = np.log((prior + 1e-6) / (1 - prior + 1e-6))
        return knots, weights
    knots = _knots(np.vstack([positives, unlabelled]))
    return knots, fit_nnpu(_basis(positives, knots), _basis(unlabelled, knots), prior)


def score(values: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    knots, weights = model
    return _sigmoid(_basis(values, knots) @ weights)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series(list(map(features, texts)), dtype=object)


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
) -> tuple[np.ndarray, np.ndarray]:
    """Fit on about ``max_positives`` trusted documents and ``max_unlabelled`` documents of any kind.

    ``labels`` holds the training rows. Those with label 1 name the trusted positives, and the share of
    label 1 among all of them estimates the class prior; no document is ever used as a negative. Both
    samples are the documents with the smallest hashes of the id; their features reach the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    n_known, n_positive = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    n_docs = docs.select(id_col).count()
    trusted = _drawn(known.filter("_label = 1").select("_id"), "_id", max_positives, n_positive, "positive")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # About max_positives ids.
    positives = texts.join(F.broadcast(trusted), texts["id"] == trusted["_id"]).select("id", "text")
    unlabelled = _drawn(texts, "id", max_unlabelled, n_docs, "unlabelled")
    return fit(_matrix(positives), _matrix(unlabelled), n_positive / n_known if n_known else 0.5)


def _drawn(rows: DataFrame, key: str, most: int, n: int, salt: str) -> DataFrame:
    draw = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 53)) / float(1 << 53)
    return rows.filter(draw < most / max(1, n))


def _matrix(rows: DataFrame) -> np.ndarray:
    table = rows.select("id", _features("text").alias("f")).toPandas().sort_values("id", kind="stable")
    return np.array(table["f"].tolist(), np.float64).reshape(-1, len(FEATURES))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text"):
    """Column: the score of a text from 0 to 1; null is scored as the empty text."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        values = np.array(list(map(features, texts)), np.float64).reshape(-1, len(FEATURES))
        return pd.Series(score(values, model))

    return scores(F.col(text_col))
