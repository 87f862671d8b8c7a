"""TF-IDF over an exact vocabulary: fitted once, saved, loaded, applied to any table."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.operators.chunking import row_index
from pricemill.sources.staging import staged

VOCABULARY_SCHEMA = "word string, n_docs long, idx long"


_KNOWN_FIELDS = [
    T.StructField("indices", T.ArrayType(T.LongType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
]
# The words of most texts, which every task knows; a fixed number, so the rest is as exact as they are.
FREQUENT = 200_000
_HELD = 200_000
_ROWS = 512
_WORD = re.compile("[a-z0-9]+")


def lowered(text: str | Column) -> Column:
    """The text in lower case; its words are its runs of a-z and 0-9, and null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.coalesce(text, F.lit("")))


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n_docs`` of a task's texts; a word has a row for each ``_HELD`` words that were held at once."""

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n_docs"])

    counts = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(set(_WORD.findall(text.as_py())))
            if len(counts) >= _HELD:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def _weighed(shared: Broadcast, names: list[str]):
    """Per text the numbers and weights of its frequent words, by number, and its other words with their counts."""

    def lists(parts, kind):
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if kind != pa.string() else [w for p in parts for w in p], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, idf = shared.value
        places = dict(zip(words, range(len(words))))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                indices, values, others, counts = [], [], [], []
                for text in part.column("_text"):
                    counted = Counter(_WORD.findall(text.as_py()))
                    at = np.fromiter((places.get(word, -1) for word in counted), np.int64, len(counted))
                    n = np.fromiter(counted.values(), np.int64, len(counted))
                    known = at >= 0
                    # Places ascend with numbers.
                    order = np.argsort(at[known])
                    here = at[known][order]
                    indices.append(numbers[here])
                    values.append(n[known][order] * idf[here])
                    others.append(list(compress(counted, ~known)))
                    counts.append(n[~known])
                columns = [lists(indices, pa.int64()), lists(values, pa.float64()), lists(others, pa.string()), lists(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_row"), *columns], names)

    return run


@dataclass
class TextVocabulary:
    """Words with the number of texts that hold them, numbered by that number, most first, then by the word."""

    words: DataFrame
    n_texts: int

    def save(self, path: str) -> None:
        self.words.withColumn("n_texts", F.lit(self.n_texts)).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextVocabulary":
        stored = spark.read.schema(f"{VOCABULARY_SCHEMA}, n_texts long").parquet(path)
        n_texts = stored.agg(F.max("n_texts")).first()[0] or 0
        return TextVocabulary(stored.drop("n_texts"), n_texts)

    def idf(self) -> Column:
        """Logarithm of (texts + 1) / (texts with the word + 1)."""
        return F.log((F.lit(self.n_texts) + 1.0) / (F.col("n_docs") + 1.0))

    def vectors(self, table: DataFrame, key: str = "sample_id", text: str = "catalog_content") -> DataFrame:
        """``key, indices, values``: one sparse vector per row of ``table``, indices ascending.

        A value is the count of the word in the text times its idf; words that the vocabulary lacks, and rows
        without words, add nothing. A text is counted where it is read, and the ``FREQUENT`` most common words,
        most of a text, get their values there. Only the other words meet the vocabulary in a plain join by word,
        none of which many texts hold, and come back to their text. Rows that share a key keep one vector each.
        """
        words = self.words.withColumn("idf", self.idf())
        frequent = words.filter(F.col("idx") < FREQUENT).select("word", "idx", "idf").orderBy("idx").toArrow()
        shared = table.sparkSession.sparkContext.broadcast(
            (frequent["word"].to_pylist(), frequent["idx"].to_numpy(), frequent["idf"].to_numpy())
        )
        keyed = table.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), lowered(text).alias("_text"))
        schema = T.StructType([*keyed.schema.fields[:2], *_KNOWN_FIELDS])
        # The key and row number are settled before two uses, which must agree on them.
        keyed = staged(keyed.mapInArrow(_weighed(shared, schema.names), schema), "text-words")
        others = keyed.select("_row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("_row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        hits = others.join(words.filter(F.col("idx") >= FREQUENT), "word").select("_row", F.struct("idx", (F.col("n") * F.col("idf")).alias("value")).alias("e"))
        rare = hits.groupBy("_row").agg(F.array_sort(F.collect_list("e")).alias("e"))
        joined = keyed.select("_row", "_key", "indices", "values").join(rare, "_row", "left")

        def both(name, more):
            return F.when(F.col("e").isNull(), F.col(name)).otherwise(F.concat(name, F.col(f"e.{more}"))).alias(name)

        return joined.select(F.col("_key").alias(key), both("indices", "idx"), both("values", "value"))


def fit_vocabulary(table: DataFrame, text: str = "catalog_content", min_docs: int = 1) -> TextVocabulary:
    """The exact vocabulary of a text column: every word that at least ``min_docs`` texts hold.

    Words are made distinct inside each text and counted before the shuffle, so a word that every text holds
    is a few rows per task. Only words are sorted, in ranges, for their numbers. Null texts count as texts.
    """
    words = table.select(lowered(text)).mapInArrow(_text_counts, "word string, n_docs long")
    counts = words.groupBy("word").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    ranked = counts.withColumn("_most", -F.col("n_docs"))
    numbered = row_index(ranked, ["_most", "word"], spread_copies=False).select("word", "n_docs", "idx")
    return TextVocabulary(staged(numbered, "vocabulary"), table.count())
