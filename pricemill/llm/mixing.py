"""Mixing sources to target weights by systematic sampling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.locate import PLACE, located
from pricemill.operators.chunking import row_index
from pricemill.sources.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17


def word_count(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code point order, null last, take the weights in turn and split ``share`` of the total.
    A target stops at ``most`` times the size of its source, and the excess is split again by weight among
    the others until none is above. One pass per round of stopping; two numbers per round reach the driver.
    """
    ordered = sizes.select("source", "source_size", F.col("source").isNull().alias("last"))
    ranked = row_index(ordered, ["last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = staged(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")),
        "sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        free, held = ranked.agg(
            F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, F.col("cap")))
        ).first()
        # Targets never fall from round to round, so a source that stopped stays stopped.
        new = (share * total - (held or 0.0)) / free if free else level
        if new == level or not free:
            break
        level = new
    share_of = F.col("weight") * F.lit(level or 0.0)
    return ranked.select("source", "source_size", F.least(share_of, "cap").alias("target"))


def mixed(rows: DataFrame, seed: int = SEED, ties: tuple[str, ...] = (), **how) -> DataFrame:
    """Add (source_size, target, copies) to rows (doc_id, source, size, ...): how often the mix takes each.

    Within a source the rows stand in order of size, of a seeded hash of the id, of the columns ``ties`` and of a
    hash of the row. Every row expects
    target / source_size copies; the running sum plus one random offset per source crosses whole numbers,
    and a row is taken once per crossing. Neighbours in the order have like sizes, so the words taken come
    within about one row of the target, and no row is taken more often than the expectation rounded up.
    The offset is a hash of seed and source: reruns agree, on any partitioning.

    One range shuffle numbers the rows; a source may hold any share of them. Null is a source of its own.
    A source without words has target 0 and is not taken.
    """
    keyed = rows.withColumns(
        {"_order": F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id")), "_named": F.col("source").isNotNull()}
    )
    placed = row_index(keyed, ["_named", "source", "size", "_order", *ties])
    sources = staged(
        placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("idx").alias("_first")), "mix-sources"
    )
    aims = targets(sources.select("source", "source_size"), **how)
    joined = sources.select(F.col("source").alias("_s"), "_first").join(
        aims.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    md5 = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    offset = F.conv(F.substring(md5, 1, 8), 16, 10).cast("double") / 4294967296.0
    slot = F.col("idx") - F.col("_first")
    copies = F.floor((slot + 1) * expected + offset) - F.floor(slot * expected + offset)
    # A plain join: broadcast while the sources are small, else shuffled, a hot source split at run time.
    return (
        placed.join(joined, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", copies.cast("long"))
        .drop("_order", "_named", "_first", "_s", "_t", "idx")
    )


def mix(docs: DataFrame, seed: int = SEED, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Only ids, sources, sizes and places of rows are numbered; the rows themselves meet the number of their
    copies by place, in one join. Rows that share an id and a text are told apart by their place in the files.
    """
    rows = located(docs)
    text = F.col(f"row.`{text_col}`")
    numbers = rows.select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        F.col(f"row.`{source_col}`").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("text_hash"),
        *PLACE,
    )
    taken = mixed(numbers, seed, ("text_hash",), **how).filter("copies > 0")
    copies = staged(taken.select(*PLACE, F.col("copies").cast("int").alias("_copies")), "mix-copies")
    # One plan at every size: the rows are shuffled once.
    joined = rows.join(copies.hint("merge"), PLACE)
    return joined.select(F.explode(F.array_repeat("row", F.col("_copies"))).alias("row")).select("row.*")
