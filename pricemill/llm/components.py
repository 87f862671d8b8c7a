"""Connected components of a large graph by alternating stars, one written table per round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.sources.staging import staged

_MAX_ROUNDS = 60


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its neighbours v; a hub is one row per task before the shuffle."""
    minima = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(minima, "u")


def _star_round(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node moves to the smallest node it sees."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u != v").distinct()  # u > v
    small = _with_minimum(large)
    moved = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = small.select("u", F.col("m").alias("v"))
    return moved.unionAll(own).filter("u != v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    ``edges`` may repeat, point either way or hold loops; rows with a null end are left out. The table of a
    round is written to the shared folder, so a lost executor costs one round; only a count and a checksum
    per round reach the driver. Rounds grow with the logarithm of the component size.
    """
    a, b = F.col(left), F.col(right)
    current = staged(
        edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(_MAX_ROUNDS):
        now = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")).first()
        if now == before or now.n == 0:
            break
        before = now
        current = staged(_star_round(current), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
