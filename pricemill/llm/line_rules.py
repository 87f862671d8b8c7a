"""Quality rules: lines that many documents of a host share, and repetition inside a document."""

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.llm.components import components
from pricemill.llm.simhash import fingerprint_links, fingerprint_of
from pricemill.llm.worker import release_worker_state
from pricemill.sources.staging import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A line is boilerplate if it stands in more than this share of the different documents of its host, and in
# more than so many of them.
MAX_LINE_PERCENT = 5
MIN_LINE_DOCUMENTS = 10
# A document that loses more than this share of its words is depleted.
MAX_REMOVED_PERCENT = 50
# Rows of one line are dealt to so many groups when the lines over the limit are looked up.
SALTS = 32

_SYMBOLS = re.compile(r"[#*$%&|<>]")

_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = T.StructType([T.StructField(name, T.LongType()) for name in _NAMES])


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, letters in words, symbols, lines equal to an earlier line, words in repeated 3-word windows."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    # Continuation bytes are not code points of their own.
    joined = b"".join(words)
    letters = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
    lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").split()]
    return (
        len(words),
        len(joined) - letters,
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
    )


def _repeat_words(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(end, at)
            end = at + 3
    return total


@F.pandas_udf(STATS)
def _stats(texts: pd.Series) -> pd.DataFrame:
    release_worker_state()
    return pd.DataFrame(map(text_stats, texts), columns=_NAMES)


def base_failed(stats):
    """Column: too few words, or over half of them in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def _normal(line):
    """A line in lower case with single blanks; lines that agree in this form are one line."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _line_hash(line):
    return F.xxhash64(_normal(line))


def _over_the_limit(distinct: DataFrame, members: DataFrame, max_percent: int, min_documents: int) -> DataFrame:
    """(host, line) of distinct rows (host, line, document) that pass both limits; ``members`` has a row
    (host, document) per document. Few lines pass the second limit, so the hosts join few rows."""
    counted = distinct.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    hosts = members.distinct().groupBy("host").agg(F.count("*").alias("documents"))
    over = 100 * F.col("n") > max_percent * F.col("documents")
    return counted.join(hosts, "host").filter(over).select("host", "line", "n")


def frequent_lines(
    docs: DataFrame, text_col: str, host_col: str, max_percent: int = MAX_LINE_PERCENT, min_documents: int = MIN_LINE_DOCUMENTS
) -> DataFrame:
    """(host, line) hashes of the lines that more than ``max_percent`` of the different texts of a host hold, and
    more than ``min_documents`` of them.

    Copies of a text are one document: they are one row per task before the first shuffle. A null host is
    a host of its own; lines without a word are no lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host")
    lines = F.array_distinct(F.transform(F.split(text, "\n", -1), _normal))
    held = docs.select(
        host, F.xxhash64(text).alias("document"), F.explode(F.filter(lines, lambda line: line != "")).alias("line")
    )
    distinct = held.select("host", F.xxhash64("line").alias("line"), "document").distinct()
    return _over_the_limit(distinct, docs.select(host, F.xxhash64(text).alias("document")), max_percent, min_documents)


def frequent_lines_of_classes(
    docs: DataFrame, text_col: str, host_col: str, max_percent: int = MAX_LINE_PERCENT, min_documents: int = MIN_LINE_DOCUMENTS
) -> DataFrame:
    """Like ``frequent_lines``, but texts that are near copies of each other (see ``simhash``) count once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.array_distinct(F.transform(F.split(text, "\n", -1), _normal))
    # A text without lines still is a document of its host: it has one null line.
    held = docs.select(
        F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host"),
        fingerprint_of(F.col(text_col)).alias("fp"),
        F.filter(lines, lambda line: line != "").alias("lines"),
    ).select("host", "fp", F.explode_outer("lines").alias("line"))
    line = F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("line")
    distinct = staged(held.select("host", line, "fp").distinct(), "line-holders")
    found = components(fingerprint_links(distinct.select("fp").distinct()), "a", "b")
    classes = distinct.join(found, distinct.fp == found.node, "left").select(
        "host", "line", F.coalesce("root", "fp").alias("document")
    )
    lines = classes.filter(F.col("line").isNotNull()).distinct()
    return _over_the_limit(lines, classes.select("host", "document"), max_percent, min_documents)


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_percent: int = MAX_LINE_PERCENT,
    min_documents: int = MIN_LINE_DOCUMENTS,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
    near_copies: bool = False,
) -> DataFrame:
    """(row, stats, text, removed_words, base_failed, kept), one row per row of ``docs``.

    ``row`` holds the columns of ``docs``, ``text`` is the text without the frequent lines of its host
    (unchanged, null included, if it has none), ``removed_words`` the words of those lines. ``kept`` is
    false if the base rules fail or more than ``max_removed_percent`` of the words were removed. Empty and
    null texts fail the base rules.

    A line is frequent if more than ``max_percent`` of the different documents of the host hold it, and more
    than ``min_documents``. Copies count once; with ``near_copies`` near copies do too, so that a large group of them is not rejected
    for the lines that only its members share.

    Lines are counted and looked up by hashes. What to cut is joined back per (host, text): the rows stay
    where they are while that list is small enough to broadcast, else they are shuffled once. A line, a
    text or a host may occur in any share of the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.xxhash64(F.col(host_col).isNull(), F.col(host_col))
    count = frequent_lines_of_classes if near_copies else frequent_lines
    frequent = staged(count(docs, text_col, host_col, max_percent, min_documents), "frequent-lines")
    salted = frequent.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    words = F.coalesce(F.regexp_count(F.col("raw"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    lines = docs.select(
        host.alias("host"),
        F.xxhash64(text).alias("document"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "raw"),
    ).select("host", "document", "at", _line_hash(F.col("raw")).alias("line"), words.alias("words"))
    lines = lines.filter("words > 0").withColumn("salt", F.pmod("document", F.lit(SALTS)).cast("int"))
    # Copies of a text in a host give the same lines: one row each.
    hits = lines.join(salted, ["host", "line", "salt"]).groupBy("host", "document", "at").agg(
        F.max("words").alias("words")
    )
    cuts = hits.groupBy("host", "document").agg(
        F.collect_list("at").alias("cut_lines"), F.sum("words").alias("cut_words")
    )
    # Else a filter on the result would be moved below and the texts be counted twice.
    stats = _stats.asNondeterministic()
    rows = docs.select(
        F.struct("*").alias("row"),
        stats(F.col(text_col)).alias("stats"),
        host.alias("host"),
        F.xxhash64(text).alias("document"),
    )
    joined = rows.join(cuts, ["host", "document"], "left")
    whole = F.col(f"row.`{text_col}`")
    left = F.filter(
        F.transform(F.split(whole, "\n", -1), lambda line, at: F.when(~F.array_contains("cut_lines", at), line)),
        lambda line: line.isNotNull(),
    )
    removed = F.coalesce("cut_words", F.lit(0).cast("long"))
    failed = base_failed(F.col("stats"))
    depleted = 100 * removed > max_removed_percent * F.col("stats.n_words")
    return joined.select(
        "row",
        "stats",
        F.when(F.col("cut_lines").isNull(), whole).otherwise(F.array_join(left, "\n")).alias("text"),
        removed.alias("removed_words"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
    )


def cleaned(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The kept rows of ``docs``, each without the frequent lines of its host."""
    kept = judged(docs, text_col=text_col, **how).filter("kept")
    return kept.select(
        *[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
