"""Benchmark decontamination with a generalised suffix automaton over item words."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.worker import release_worker_state
from pricemill.sources.staging import staged

WINDOW = 13
MIN_COVERAGE = 0.05
# Words of one automaton, about 150 MB in the driver and in each worker; a larger benchmark is streamed in
# blocks of items.
BLOCK_WORDS = 250_000

# ASCII letters are lower-cased, other ASCII signs but digits divide words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, each inserted from the root.

    ``ends`` maps a state to the items that have a window whose occurrence is recognised there: windows of
    ``window`` words, or a whole item of fewer.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.windows: dict[tuple[int, int], list[str]] = {}
        for name, sequence in sequences:
            span = min(window, len(sequence))
            for state in dict.fromkeys(s for s, n in self.walk(sequence, span) if n == span) if span else ():
                self.windows.setdefault((state, span), []).append(name)
        # Spans of short items, to look for besides the long windows.
        self.spans = sorted({span for _, span in self.windows})

    @classmethod
    def restored(cls, state: dict) -> "Automaton":
        """The automaton with these attributes; broadcasts carry plain values."""
        made = cls.__new__(cls)
        made.__dict__ = state
        return made

    def _clone(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, start: int, word: int, target: int) -> int:
        """A state for the strings of ``target`` that are at most one word longer than ``start``."""
        copy = self._clone(target, self.length[start] + 1)
        self.link[target] = copy
        while start >= 0 and self.next[start].get(word) == target:
            self.next[start][word] = copy
            start = self.link[start]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # the sequence so far occurs in an earlier item
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            exact = self.length[target] == self.length[at] + 1
            self.link[new] = target if exact else self._split(at, word, target)
        return new

    def walk(self, sequence: list[int], most: int) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest match that ends there, cut to ``most`` words."""
        state = matched = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= most:
                state = self.link[state]
            matched = min(matched, most)
            yield state, matched

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (first word, end) of all window occurrences, and the items whose windows occur."""
        found, items = [], set()
        if not self.spans or len(words) < self.spans[0]:
            return found, items
        get = self.vocabulary.get
        known = np.array([get(w, -1) for w in words], np.int64)
        # A window lies in a run of item words.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).astype(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.spans[0]:
                continue
            run = known[start:end].tolist()
            # One walk finds the longest match; shorter windows are suffixes of it, up the links.
            for at, (state, matched) in enumerate(self.walk(run, self.spans[-1])):
                for span in reversed(self.spans):
                    if span > matched:
                        continue
                    while self.length[self.link[state]] >= span:
                        state = self.link[state]
                    names = self.windows.get((state, span))
                    if names:
                        found.append((start + at + 1 - span, start + at + 1))
                        items.update(name for name in names if name is not None)
        return merged(found), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Lists of items of about ``block_words`` words; the driver holds one block at a time."""
    block, held = [], 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        block.append((name, words))
        held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>, cut string"


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(row, n_words, starts, ends, items, cut) per row of ``docs``; ``row`` holds its columns.

    ``starts`` and ``ends`` bound the merged occurrences of item windows as word positions, ``items`` the ids of items with
    an occurring window, as sorted text; ``cut`` is the text without the spans, null if it has none. Null texts
    have no words; items without words are left out; the windows of an item without an id are hit like others,
    but it is not listed; items that share an id count as one. An automaton is broadcast with ``block_words`` words (and
    one item) at most; a larger benchmark takes one pass over the written rows per block of items.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    none = "cast(array() as array<int>)"
    rows = rows.selectExpr("row", "text", f"{none} starts", f"{none} ends", "cast(array() as array<string>) items")
    blocks = _item_blocks(benchmark, item_col, item_text_col, block_words)
    block = next(blocks, [])
    while True:
        shared = docs.sparkSession.sparkContext.broadcast(vars(Automaton(block, window)))
        rows = rows.withColumn("found", _matcher(shared)("text", "starts", "ends", "items"))
        rows = rows.selectExpr("row", "text", "found.*")
        block = next(blocks, None)
        if block is None:
            return rows.drop("text")
        rows = staged(rows, "decontamination")


def _matcher(shared):
    @F.pandas_udf(FOUND)
    def match(texts: pd.Series, starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        release_worker_state()
        automaton, out = Automaton.restored(shared.value), []
        for text, old_starts, old_ends, old_items in zip(texts, starts, ends, items):
            words = words_of(text)
            spans, names = automaton.hits(words)
            spans = merged([*spans, *zip(old_starts, old_ends)])
            starts_, ends_ = [s for s, _ in spans], [e for _, e in spans]
            cut = _cut(text, starts_, ends_) if spans else None
            out.append((len(words), starts_, ends_, sorted(names.union(old_items)), cut))
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items", "cut"])

    # Else a filter on what is found would be moved below and the texts be searched twice.
    return match.asNondeterministic()


def hit_words():
    """Column: words inside the spans."""
    lengths = F.zip_with("starts", "ends", lambda start, end: (end - start).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda n, length: n + length)


def contaminated(n_hit, n_words, min_coverage: float = MIN_COVERAGE):
    """Column: hit words are at least ``min_coverage`` of the words (5 %: 20 n_hit >= n_words)."""
    return (n_hit > 0) & (n_hit * round(1 / min_coverage) >= n_words)


def _cut(text: str, first, end) -> str:
    """``text`` without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    marks = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in zip(first, end):
        kept.append(data[at : starts[a]])
        at = int(ends[b - 1])
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without benchmark text: rows over the coverage limit are dropped whole, and from the others
    every span (``window`` or more item words) is cut out of the text. Rows without a span stay as they are."""
    found = find_overlaps(docs, benchmark, text_col, **how)
    kept = found.filter(~contaminated(hit_words(), F.col("n_words")))
    text = F.coalesce("cut", F.col(f"row.`{text_col}`"))
    return kept.select(
        *[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def item_digest():
    """Column: sha256 of the comma-joined items."""
    return F.sha2(F.array_join("items", ","), 256)

