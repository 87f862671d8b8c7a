"""Groups of products that share a text or a link, and a holdout that never parts a group."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.hashing import unit_hash
from pricemill.schema import SAMPLE_SEED
from pricemill.sources.staging import staged

_MAX_ROUNDS = 80


def normal_text(text: str | Column = "catalog_content") -> Column:
    """Lower case, runs of other signs than letters and digits as one blank; null where nothing is left."""
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), F.lit(""))


def group_keys() -> dict[str, Column]:
    """What makes two products one: the normalised text, and the link."""
    return {"text": normal_text("catalog_content"), "link": F.nullif(F.trim("image_link"), F.lit(""))}


def product_groups(products: DataFrame, id_col: str = "sample_id", keys: dict[str, Column] | None = None) -> DataFrame:
    """``id, group`` per distinct id: ids joined by equal keys, over any number of steps; ``group`` is the smallest id.

    A key that is null joins nothing; rows that share an id are one product. Rows without an id have none.
    Products and keys are the two sides of a graph. In a round every key takes the smallest label among its
    products and every product the smallest among its keys, and then the label of its label, so chains of
    any length take a number of rounds that grows with the logarithm of their length. A key that a third of all
    products share is one row per task before each shuffle; its products meet the key's one row in a plain join,
    which Spark splits at run time. Keys move as 128 bits. Each round is one written table, so a lost executor
    costs a round; only a count per round reaches the driver.
    """
    keys = keys or group_keys()
    hashes = [F.struct(F.lit(name).alias("kind"), F.xxhash64(F.lit(name), value).alias("h"), F.xxhash64(value, F.lit(name)).alias("g"), value.isNull().alias("none")) for name, value in keys.items()]
    rows = products.filter(F.col(id_col).isNotNull())
    edges = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*hashes)).alias("k")).filter("not k.none")
    edges = edges.select("id", F.struct("k.h", "k.g").alias("key")).distinct()
    # A key of a single product joins nothing.
    shared = edges.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    edges = staged(edges.join(shared, "key"), "group-edges")
    ids = rows.select(F.col(id_col).alias("id")).distinct()
    labels = staged(edges.select("id").distinct().select("id", F.col("id").alias("label")), "group-labels")
    for _ in range(_MAX_ROUNDS):
        of_key = edges.join(labels, "id").groupBy("key").agg(F.min("label").alias("least"))
        seen = edges.join(of_key, "key").groupBy("id").agg(F.min("least").alias("least"))
        stepped = labels.join(seen, "id").select("id", F.col("label").alias("before"), F.least("label", "least").alias("label"))
        # The label of the label: the smallest that the product named by it has seen.
        named = seen.select(F.col("id").alias("label"), F.col("least").alias("next"))
        jumped = stepped.join(named, "label", "left").select("id", "before", F.least("label", "next").alias("label"))
        labels = staged(jumped, "group-labels")
        if labels.filter("label != before").isEmpty():
            break
        labels = labels.select("id", "label")
    else:
        raise RuntimeError("groups did not settle")
    return ids.join(labels.select("id", "label"), "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("label", "id").alias("group")
    )


def grouped_holdout(
    products: DataFrame, share: float = 0.1, seed=SAMPLE_SEED, id_col: str = "sample_id", keys: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``group`` and ``holdout``: a hash of the group decides, so what joins two products never lies on both sides.

    About ``share`` of the groups are held out, not of the rows: a group stays whole, whatever its size. Rows
    without an id have no group and are not held out.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"share must be from 0 to 1, not {share}")
    groups = product_groups(products, id_col, keys)
    held = F.coalesce(unit_hash(seed, "group") < share, F.lit(False))
    return products.join(groups, id_col, "left").withColumn("holdout", held & F.col("group").isNotNull())


def leaks(split: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """``kind, n_keys``: values of each key that stand on both sides of a split, none after ``grouped_holdout``."""
    keys = keys or group_keys()
    sides = [
        split.select(F.lit(name).alias("kind"), F.xxhash64(value).alias("h"), F.xxhash64(value, F.lit(1)).alias("g"), value.isNull().alias("none"), "holdout")
        for name, value in keys.items()
    ]
    rows = reduce(DataFrame.unionAll, sides).filter("not none")
    both = rows.groupBy("kind", "h", "g").agg((F.min("holdout") != F.max("holdout")).alias("both"))
    return both.groupBy("kind").agg(F.count_if("both").alias("n_keys"))
