"""SimHash near-duplicates through an inverted index over byte positions with count filtering."""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.llm.components import components
from pricemill.llm.locate import PLACE, located
from pricemill.llm.worker import release_worker_state
from pricemill.sources.staging import staged

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
# 3 differing bits touch 3 bytes at most, so linked fingerprints share at least 5 of 8 positional bytes.
MIN_BYTES = 8 - MAX_BITS
CELL_ROWS = 1024
_EDGE_BUFFER = 1_000_000


def fingerprint(text: str | None) -> int:
    """64 bits; bit b is 1 if it is set in over half of the shingle hashes. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE_WORDS + 1
    if n < 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist())]
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(rows), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    release_worker_state()
    values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def fingerprint_of(text):
    """Column: the fingerprint as a signed 64-bit number."""
    return _fingerprints(text)


def position_sets() -> list[tuple[int, ...]]:
    """14 sets of 4 of the 8 byte positions, such that any 5 positions hold one of the sets whole.

    These are the planes of the 3-dimensional space over two elements: positions as bit vectors whose sum
    is zero. Any 3 positions lie in one plane, and the complement of a plane is a plane.
    """
    return [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def _masks() -> list[int]:
    values = [sum(0xFF << (8 * i) for i in p) for p in position_sets()]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the edges (a, b) over 0..n-1: each node and its smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _links_in_cells(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among rows with equal neighbouring keys: tally shared bytes, keep 5 or more, verify bits."""
    n, step = len(fps), 1
    heads, tails, held = [], [], 0
    here = np.arange(n)
    while True:
        here = here[here < n - step]
        here = here[keys[here] == keys[here + step]]
        if not len(here):
            break
        differ = fps[here] ^ fps[here + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        close = shared >= MIN_BYTES
        close[close] = np.bitwise_count(differ[close]) <= MAX_BITS
        found = here[close]
        heads.append(found)
        tails.append(found + step)
        held += len(found)
        if held > _EDGE_BUFFER:
            head, tail = _stars(np.concatenate(heads), np.concatenate(tails), n)
            heads, tails, held = [head], [tail], 0
        step += 1
    if not heads:
        return here, here
    return _stars(np.concatenate(heads), np.concatenate(tails), n)


def _cell_links(batches):
    """Rows come sorted by cell; a cell that runs over the end of a batch waits for the next one."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = rows["cell"].to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = rows.iloc[last:].reset_index(drop=True)
        yield from _emit(rows.iloc[:last])
    if rest is not None:
        yield from _emit(rest)


def _emit(rows):
    if len(rows):
        fps = rows["fp"].to_numpy().astype(np.int64)
        a, b = _links_in_cells(rows["cell"].to_numpy(), np.ascontiguousarray(fps).view(np.uint64))
        yield pd.DataFrame({"a": fps[a], "b": fps[b]})


def fingerprint_links(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that join the same fingerprints as all links would.

    ``fps`` has one row per distinct ``fp``. A list of the index holds the fingerprints that agree in the
    bytes at four positions (see ``position_sets``): every linked pair meets in at least one list, and lists
    of single bytes, which grow with the table, are never walked. A list is dealt into chunks of about
    ``cell_rows``, and each pair of chunks is one cell, so no task holds a whole list and no pair is
    missed; a cell returns a star forest instead of its pairs.
    """
    sets = F.array([F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(_masks())])
    keyed = fps.select("fp", F.explode(sets).alias("s")).select(
        "fp", F.xxhash64("s.i", F.col("fp").bitwiseAND(F.col("s.m"))).alias("list")
    )
    sizes = keyed.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / cell_rows)
    listed = keyed.join(sizes, "list").withColumn("chunks", chunks)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks"))
    cells = listed.select("fp", "list", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    cells = cells.select("fp", F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(_cell_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, root, component_id).

    Fingerprints that differ in 3 bits or fewer are linked; ``root`` names the component (its smallest
    fingerprint) and ``component_id`` is its smallest id. Rows without words all have fingerprint 0. A null
    id never is the smallest; a component of null ids only has a null ``component_id``.
    """
    prints = staged(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(F.col(text_col)).alias("fp")), "fingerprints"
    )
    return with_components(prints)


def members_of(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) per different fingerprint of written rows (doc_id, fp)."""
    fps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(fingerprint_links(fps), "a", "b")
    rooted = fps.join(found, fps.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged(rooted.select("fp", "root").join(named, "root"), "components")


def with_components(prints: DataFrame) -> DataFrame:
    """Add ``root`` and ``component_id`` to written rows (doc_id, fp)."""
    return prints.join(members_of(prints), "fp", "left").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Of repeated rows with that id the one with the smallest fingerprint stays, of equal ones that with the
    smallest hash of its text, then the first in the files. Fingerprints and places are worked out alone; the
    rows themselves meet only the list of places to keep, in one join.
    """
    rows = located(docs)
    text = F.col(f"row.`{text_col}`")
    numbers = rows.select(
        F.col(f"row.`{id_col}`").alias("doc_id"), fingerprint_of(text).alias("fp"), F.xxhash64(text).alias("text_hash"), *PLACE
    )
    prints = staged(numbers, "fingerprinted")
    linked = prints.join(members_of(prints.select("doc_id", "fp")), "fp")
    kept = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
    kept = staged(kept.agg(F.min(F.struct("fp", "text_hash", *PLACE)).alias("k")).select("k.*").select(*PLACE), "kept-rows")
    # One plan at every size: the rows are shuffled once.
    return rows.join(kept.hint("merge"), PLACE, "left_semi").select("row.*")
