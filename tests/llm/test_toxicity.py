"""The registered toxicity model: held-out documents by language, hidden insults, words that only look like insults."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from pricemill.llm import toxicity
from pricemill.llm.queries import _remainder

TABLES = "/root/testdata/sf0.1"
INSULTS = ["idiot", "moron", "loser", "trash", "scum", "stupid", "clown", "pathetic", "disgusting", "worthless"]


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("needs the larger tables")
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    return toxicity.train(docs, labels.filter(_remainder("doc_id", 5) != 0))


@pytest.fixture(scope="module")
def held_out(spark, model):
    """(lang, toxic, predicted) of the labelled documents that training did not see."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("toxic in (0, 1)")
    rows = rows.select("doc_id", "lang", "toxic", (toxicity.scored(rows, model) >= 0.5).alias("predicted")).collect()
    return [(r.lang, r.toxic, r.predicted) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]


def test_held_out_recall_and_precision(held_out):
    caught = sum(toxic and predicted for _, toxic, predicted in held_out)
    # Some labelled toxic documents hold nothing but prose, some clean ones a word that makes others toxic.
    assert caught >= 0.9 * sum(toxic for _, toxic, _ in held_out)
    assert caught >= 0.8 * sum(predicted for _, _, predicted in held_out)


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_every_language(held_out, lang):
    rows = [(toxic, predicted) for of, toxic, predicted in held_out if of == lang]
    toxic, clean = [p for t, p in rows if t], [p for t, p in rows if not t]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.06 * len(clean)


def test_hidden_insults(model):
    hidden = ["id1ot", "idi0t", "m0ron", "l0ser", "tr4sh", "iddiot", "sstupiid"]
    assert [w for w, m in zip(hidden, model.margins(hidden)) if m < 0] == []


def test_single_inserted_letters(model):
    forms = [w[:i] + c + w[i:] for w in INSULTS for i in range(1, len(w)) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert (model.margins(forms) >= 0).mean() >= 0.9


def test_neighbours_of_insults_are_clean(model):
    clean = ["closer", "crash", "moral", "empathetic", "achlich", "r\u00e9eux", "bomente", "boco", "trust", "clone", "path", "worth"]
    assert [w for w, m in zip(clean, model.margins(clean)) if m >= 0] == []


def test_scores_are_the_highest_window(spark, model):
    rows = [(None,), ("",), ("the and of",), ("the and of. you idiot of the",), ("idiot",)]
    docs = spark.createDataFrame(rows, "text string").coalesce(1)
    none, empty, clean, sentence, word = (r.s for r in docs.select(F.round(toxicity.scored(docs, model), 9).alias("s")).collect())
    assert none == empty < clean < 0.5 <= sentence == word
