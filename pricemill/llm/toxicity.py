"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

A document hands its label to its sentences, and a sentence to its windows: words, words without the signs inside,
runs of single letters joined, pieces of long words. A sentence, and so a document, scores as its highest window.
"""

import re
import string
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.llm.worker import worker_state

# Common subsequences of so many letters, every order normalised on its own and averaged; a letter left out between
# two of them costs one decay, a match nothing. The average is raised to a power, which parts near neighbours.
ORDERS = (2, 3, 4)
DECAY = 0.8
POWER = 3
# The kernel is 0 where the longest common subsequence has less than this share of the landmark's signs.
SHARE = 0.6
# A bounded sample of labelled documents is all that the fit sees.
MAX_DOCUMENTS_PER_CLASS = 2000
# Landmarks: words of toxic documents, clean words near them, and per further round words that the machine gets wrong.
MAX_TOXIC_LANDMARKS = 96
MAX_CLEAN_LANDMARKS = 64
MAX_ADDED_LANDMARKS = 64
ROUNDS = 3
MAX_CLEAN_WORDS = 4000
MAX_HIGH_WORDS = 1500
_RIDGE = 1e-5
# What each kind of training window weighs in all.
_WEIGHTS = {"toxic": 1.0, "inserted": 3.0, "replaced": 4.0, "clean": 8.0, "other": 2.0, "unlike": 2.0}
# A fold of the documents is left out of a first fit and places the cut, within these margins.
_FOLDS = 4
_MOST_SHIFT = 0.15
_PIECE = 24
_PAIRS = 16384
_CACHE_WORDS = 200_000
_CHUNK_CHARS = 1_000_000
_NONE = -10.0
_NO_SIGNS = str.maketrans("", "", string.punctuation)
_NO_VOWELS = str.maketrans("", "", "aeiou")
_DIGITS = {"a": "4", "e": "3", "i": "1", "o": "0"}
_APART = re.compile(r"[\W_]+")
# Three or more single letters or digits with any white space and signs between them.
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]++[^\W_](?![^\W_])){2,}")


def candidates(text: str | None) -> set[str]:
    """What may be an insult: words in lower case without punctuation around them, those with signs inside
    also without the signs, and runs of single letters, whatever blanks and signs part them, joined to one
    word. Long words give overlapping pieces, so nothing is left out."""
    low = (text or "").lower()
    words = {w.strip(string.punctuation) for w in low.split()}
    words.update([w.translate(_NO_SIGNS) for w in words if not w.isalnum()])
    words.update(_APART.sub("", m[0]) for m in _SPACED.finditer(low))
    words.discard("")
    long = [w for w in words if len(w) > _PIECE]
    words.difference_update(long)
    words.update(w[i : i + _PIECE] for w in long for i in range(0, len(w) - _PIECE // 2, _PIECE // 2))
    return words


def _codes(words: list[str], width: int, filler: int) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), width), filler, np.int32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _subsequences(codes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Kernel of each order for each row of ``codes`` (n, length) with ``other`` (1 or n, m, width), by dynamic
    programming."""
    n, length = codes.shape
    m, width = other.shape[1:]
    most = max(ORDERS)
    # tail[i][j]: weighted common subsequences of i letters in the first letters of both, decayed to the ends.
    tail = [[np.ones((n, m), np.float32)] * (width + 1)]
    tail += [[np.zeros((n, m), np.float32) for _ in range(width + 1)] for _ in range(most - 1)]
    totals = np.zeros((len(ORDERS), n, m), np.float32)
    decay = np.float32(DECAY)
    for x in range(length):
        equal = [(codes[:, x, None] == other[:, :, j]).astype(np.float32) for j in range(width)]
        for total, order in zip(totals, ORDERS):
            for j in range(width):
                total += equal[j] * tail[order - 1][j]
        for i in range(most - 1, 0, -1):
            run = np.zeros((n, m), np.float32)
            for j in range(width):
                run = run * decay + equal[j] * tail[i - 1][j]
                tail[i][j + 1] = tail[i][j + 1] * decay + run
    return totals


def _norms(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    codes = _codes(words, width, -1)
    other = _codes(words, width, -2)[:, None, :]
    return np.sqrt(np.maximum(_subsequences(codes, other)[:, :, 0], 1e-12))


def _match_masks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the words in order, and per letter and word the places that hold it, as bits."""
    letters = sorted(set("".join(words)))
    masks = [[sum(1 << i for i, sign in enumerate(w) if sign == letter) for w in words] for letter in letters]
    return np.array([ord(letter) for letter in letters], np.int32), np.array([*masks, [0] * len(words)], np.uint64)


def _marked(words: list[str]) -> list[str]:
    """A sign of its own for the first letter before the word, and one for the end behind it: a letter put inside
    leaves both, a letter put before makes another word."""
    return [w[:1].upper()[:1] + w + "$" for w in words]


class Landmarks:
    """Kernel values with a fixed list of strings, between 0 and 1.

    Pairs are first sorted out by the letters they share and then by their longest common subsequence; where that
    has less than ``SHARE`` of the landmark's signs, the value is 0 by definition.
    """

    def __init__(self, words: list[str]):
        self.words, words = words, _marked(words)
        self.codes = _codes(words, max(map(len, words)), -2)
        self.norms = _norms(words)
        # Hidden forms of a piece have less than 64 signs, so the places of a landmark fit into one word of bits.
        self.letters, self.masks = _match_masks(words)
        self.full = np.array([(1 << len(w)) - 1 for w in words], np.uint64)
        self.counts = np.bitwise_count(self.masks).astype(np.float32)
        self.least = np.ceil(SHARE * np.array([len(w) for w in words])).astype(np.int64)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and landmark of all pairs whose longest common subsequence is long enough: by a row of bits per
        pair, where a bit that turned 0 counts one letter."""
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        place[self.letters[place] != codes] = len(self.letters)
        held = np.zeros((len(codes), len(self.letters) + 1), np.float32)
        held[np.arange(len(codes))[:, None], place] = 1
        # No common subsequence is longer than the landmark's letters that the word holds.
        word, mark = np.nonzero(held @ self.counts >= self.least)
        full = self.full[mark]
        open_bits = full.copy()
        for x in range(codes.shape[1]):
            met = open_bits & self.masks[place[word, x], mark]
            open_bits = ((open_bits + met) | (open_bits - met)) & full
        enough = np.bitwise_count(full ^ open_bits) >= self.least[mark]
        return word[enough], mark[enough]

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        words = _marked(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        by_length = np.argsort(lengths, kind="stable")
        for at in range(0, len(by_length), _PAIRS):
            part = by_length[at : at + _PAIRS]
            self._fill(out, part, [words[i] for i in part.tolist()], lengths[part])
        return out

    def _fill(self, out: np.ndarray, rows: np.ndarray, words: list[str], lengths: np.ndarray) -> None:
        """The values of some words in order of length."""
        codes = _codes(words, int(lengths[-1]), -1)
        word, mark = self.near(codes)
        if not len(word):
            return
        live, place = np.unique(word, return_inverse=True)
        norms = _norms([words[i] for i in live.tolist()])
        for at in range(0, len(word), _PAIRS):
            w, m = word[at : at + _PAIRS], mark[at : at + _PAIRS]
            values = _subsequences(codes[w, : lengths[w[-1]]], self.codes[m][:, None, :])[:, :, 0]
            values /= norms[:, place[at : at + _PAIRS]] * self.norms[:, m]
            out[rows[w], m] = values.mean(axis=0) ** POWER


def _fit_svm(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = _RIDGE) -> np.ndarray:
    """Squared-hinge linear machine with a bias, by Newton steps over the rows inside the margin."""
    x = np.column_stack([features, np.ones(len(features))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        inside = y * (x @ w) < 1
        rows, scale = x[inside], weight[inside] / weight.sum()
        new = np.linalg.solve(rows.T @ (rows * scale[:, None]) + penalty, rows.T @ (scale * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


class Model:
    """Words are scored by the machine; a document has the score of its worst word."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        return self.landmarks.features(words) @ self.weights + self.bias

    def worst(self, texts) -> list[float]:
        """The largest margin of each text; texts without words get the least there is."""
        bags = [candidates(t) for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known, self.older = {}, self.known
        missing = set(chain.from_iterable(bags)).difference(self.known)
        again = {w: self.older[w] for w in missing if w in self.older}
        self.known.update(again)
        new = list(missing.difference(again))
        if new:
            self.known.update(zip(new, self.margins(new).tolist()))
        return [max(map(self.known.__getitem__, bag), default=_NONE) for bag in bags]

    def state(self) -> tuple:
        return self.landmarks.words, self.weights, self.bias


def _letter(*of) -> str:
    return string.ascii_lowercase[zlib.crc32(repr(of).encode("utf-8", "surrogatepass")) % 26]


def _inserted(word: str) -> list[str]:
    """Ways to hide a word that keep all its letters: a letter put inside, a letter twice."""
    ways = [word[:i] + _letter(word, i, n) + word[i:] for i in range(1, len(word)) for n in (0, 1)]
    return ways + [word[: i + 1] + word[i:] for i in range(len(word))]


def _replaced(word: str) -> list[str]:
    """Ways to hide a word that lose letters: a sign for the middle one, vowels as digits or left out. The first
    letter stays; signs between letters are taken out by ``candidates``."""
    middle, rest = len(word) // 2, word[1:]
    ways = [word[:i] + _DIGITS[word[i]] + word[i + 1 :] for i in range(1, len(word)) if word[i] in _DIGITS]
    ways += [word[0] + rest.translate(_NO_VOWELS), word[0] + rest.translate(str.maketrans(_DIGITS))]
    return [*ways, word[:middle] + "*" + word[middle + 1 :]]


def _others(word: str) -> list[str]:
    """Other words that look like a word: another first letter, letters before it, other endings or none."""
    a, b, c, d, e, f = (_letter(word, "other", n) for n in range(6))
    return [a + word[1:], b + word[1:], c + word, d + e + word, word[:-2] + f + a, word[:-2] + c, word[:-2]]


def _distinct(bags: list[set[str]]) -> list[set[str]]:
    """One of all bags whose eight smallest hashes agree, so that a group of copies counts once."""
    of = {}
    for bag in bags:
        key = tuple(sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in bag)[:8])
        of.setdefault(key, bag)
    return list(of.values())


def _witnesses(toxic: list[set[str]], in_toxic: Counter, in_clean: Counter) -> list[str]:
    """Words that make documents toxic: those of a fiftieth of the toxic documents that few clean ones hold; then,
    for documents without any, greedily the word of most of them that clean ones nearly never hold."""
    sure, least = max(4, len(toxic) // 50), max(2, len(toxic) // 150)
    chosen = {w for w, n in in_toxic.items() if n >= sure and 3 * in_clean[w] <= n}
    open_bags = [bag for bag in toxic if chosen.isdisjoint(bag)]
    while open_bags:
        counts = Counter(chain.from_iterable(open_bags))
        best = min(((-n, w) for w, n in counts.items() if n >= least and 10 * in_clean[w] <= n), default=None)
        if best is None:
            break
        chosen.add(best[1])
        open_bags = [bag for bag in open_bags if best[1] not in bag]
    return sorted(chosen)


def _spread(words: list[str], most: int) -> list[str]:
    """Landmarks: the first word, then always the word that is least like those chosen."""
    if len(words) <= most:
        return list(words)
    chosen = [0]
    like = Landmarks([words[0]]).features(words)[:, 0]
    while len(chosen) < most:
        nxt = int(np.argmin(like))
        chosen.append(nxt)
        like = np.maximum(like, Landmarks([words[nxt]]).features(words)[:, 0])
        like[nxt] = np.inf
    return [words[i] for i in sorted(chosen)]


def _fit(toxic: list[set[str]], clean: list[set[str]]) -> Model:
    in_toxic, in_clean = Counter(chain.from_iterable(toxic)), Counter(chain.from_iterable(clean))
    witnesses = _witnesses(toxic, in_toxic, in_clean)
    if not witnesses or not clean:
        return Model(Landmarks(["\0"]), np.zeros(1), -1.0)
    marks = _spread(witnesses, MAX_TOXIC_LANDMARKS)
    clean_words = sorted(in_clean)
    nearest = np.argsort(-Landmarks(marks).features(clean_words).max(axis=1), kind="stable")[:MAX_CLEAN_WORDS]
    known = set(witnesses)
    hard = [w for w in map(clean_words.__getitem__, nearest) if w not in known]
    inserted = {v for w in witnesses for v in _inserted(w)} - in_clean.keys() - known
    replaced = {v for w in witnesses for v in _replaced(w) if len(v) > 2} - in_clean.keys() - known
    others = {v for w in witnesses for v in _others(w) if v} - inserted - replaced - known
    # A witness that clean documents hold as well counts against itself, document for document.
    both = [w for w in witnesses if in_clean[w]]
    per_document = _WEIGHTS["toxic"] / sum(in_toxic[w] for w in witnesses)
    marks = list(dict.fromkeys(marks + _spread(hard[:400], MAX_CLEAN_LANDMARKS)))
    high_words: list[str] = []
    for turn in range(ROUNDS):
        landmarks = Landmarks(marks)
        kernel = landmarks.features(marks).astype(np.float64)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        kept = values > 1e-2
        nystroem = vectors[:, kept] / np.sqrt(values[kept])
        groups = [
            (witnesses, 1.0, [in_toxic[w] for w in witnesses], _WEIGHTS["toxic"]),
            (sorted(inserted), 1.0, None, _WEIGHTS["inserted"]),
            (sorted(replaced), 1.0, None, _WEIGHTS["replaced"]),
            (hard, -1.0, np.sqrt([in_clean[w] for w in hard]), _WEIGHTS["clean"]),
            (high_words, -1.0, np.sqrt([in_clean[w] for w in high_words]), _WEIGHTS["clean"]),
            (sorted(others), -1.0, None, _WEIGHTS["other"]),
            (both, -1.0, [in_clean[w] for w in both], per_document * sum(in_clean[w] for w in both)),
        ]
        groups = [g for g in groups if g[0]]
        words = [w for g in groups for w in g[0]]
        y = np.repeat([g[1] for g in groups], [len(g[0]) for g in groups])
        counts = [np.ones(len(g[0])) if g[2] is None else np.asarray(g[2], float) for g in groups]
        weight = np.concatenate([n / n.sum() * g[3] for n, g in zip(counts, groups)])
        features = landmarks.features(words)
        # Forms that are like no landmark teach nothing; a word that is like none is clean.
        weighed = np.where(features.any(axis=1), weight, 0.0)
        x = np.vstack([features @ nystroem, np.zeros((1, kept.sum()))])
        w = _fit_svm(x, np.append(y, -1.0), np.append(weighed, _WEIGHTS["unlike"]))
        model = Model(landmarks, nystroem @ w[:-1], float(w[-1]))
        if turn + 1 < ROUNDS:
            loss = 1 - y * (features @ model.weights + model.bias)
            order = np.argsort(-loss, kind="stable")
            taken = set(marks)
            wrong = list(dict.fromkeys(words[i] for i in order.tolist() if loss[i] > 0.6 and words[i] not in taken))
            worst, rest = wrong[: MAX_ADDED_LANDMARKS // 2], wrong[MAX_ADDED_LANDMARKS // 2 :]
            marks = marks + worst + _spread(rest[: 4 * MAX_ADDED_LANDMARKS], MAX_ADDED_LANDMARKS // 2)
        if turn == 0:
            # Clean words may be near to no single landmark and still score high.
            margins = model.margins(clean_words)
            high = np.argsort(-margins, kind="stable")[:MAX_HIGH_WORDS]
            high_words = [clean_words[i] for i in high.tolist() if margins[i] > -0.3 and clean_words[i] not in known]
    return model


def _cut(model: Model, toxic: list[set[str]], clean: list[set[str]]) -> float:
    """The margin that parts documents the machine has not seen best; the one nearest to 0 of several."""
    bags = toxic + clean
    words = sorted(set(chain.from_iterable(bags)))
    of = dict(zip(words, model.margins(words).tolist())) if words else {}
    top = np.array([max(map(of.__getitem__, bag), default=_NONE) for bag in bags])
    truth = np.repeat([1, -1], [len(toxic), len(clean)])
    cuts = sorted(np.linspace(-_MOST_SHIFT, _MOST_SHIFT, 31), key=abs)
    return float(max(cuts, key=lambda cut: int(truth[top >= cut].sum())))


def fit(toxic: list[set[str]], clean: list[set[str]]) -> Model:
    """A machine from the windows of toxic and clean documents.

    Which window makes a document toxic is not given: witnesses are words that toxic documents hold and clean ones
    hardly do. The machine learns from the witnesses, forms that hide them, the clean words that are nearest to
    them, and other words made from them; words that it gets wrong become landmarks of the next round. One document
    in four is left out of a first fit, which places the cut. Without a witness the model is constant.
    """
    toxic, clean = _distinct(toxic), _distinct(clean)
    shift = 0.0
    if len(toxic) >= 10 * _FOLDS and len(clean) >= 10 * _FOLDS:
        seen = [[bag for i, bag in enumerate(bags) if i % _FOLDS] for bags in (toxic, clean)]
        shift = _cut(_fit(*seen), toxic[::_FOLDS], clean[::_FOLDS])
    model = _fit(toxic, clean)
    return Model(model.landmarks, model.weights, model.bias - shift)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _candidates(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(candidates(t)) for t in texts], dtype=object)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """The labelled documents to learn from: about ``most`` per class at most, those with the smallest
    hashes of the id. ``labels`` holds training rows only; a null label or id is none."""
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    labels = labels.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = {row[0]: row[1] for row in labels.groupBy("_label").count().collect()}
    # At most 2**53 for exact numbers; a class below the bound is taken whole.
    draw = F.pmod(F.xxhash64("_id", F.lit(label)), F.lit(1 << 53)) / float(1 << 53)
    share = F.when(F.col("_label") == 1, most / max(1, counts.get(1, 0))).otherwise(most / max(1, counts.get(0, 0)))
    chosen = labels.filter(draw < share)
    # 2 * most rows of two numbers.
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    most: int = MAX_DOCUMENTS_PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
) -> Model:
    """Fit on a bounded sample of the labelled documents; their candidate words reach the driver."""
    rows = sample(docs.select(F.col(id_col), F.col(text_col)), labels, label, most, id_col)
    bags = rows.select("_label", "_id", _candidates(F.col(text_col)).alias("words")).toPandas()
    bags = bags.sort_values("_id", kind="stable")
    by_class = [[set(words) for words in bags["words"][bags["_label"] == c]] for c in (1, 0)]
    return fit(*by_class)


def scored(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column: the score of a text, 0 to 1, at least 0.5 where the machine says toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        def make():
            words, weights, bias = shared.value
            return Model(Landmarks(words), weights, bias)

        here, margins, chunk, held = worker_state(_key(shared.value), make), [], [], 0
        for text in texts:
            chunk.append(text)
            held += len(text or "")
            if held > _CHUNK_CHARS:
                margins += here.worst(chunk)
                chunk, held = [], 0
        margins += here.worst(chunk)
        return pd.Series(1 / (1 + np.exp(-4 * np.array(margins, np.float64))))

    return score(F.col(text_col))


def _key(state) -> str:
    words, weights, bias = state
    return f"toxicity {hash((tuple(words), weights.tobytes(), bias))}"
