"""Prefix trie of conversations: adaptive radix trees over turn ids, one per sorted run of conversations."""

import hashlib
from bisect import bisect_left

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill.sources.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
# Bytes of a turn id: the head of a SHA-256, compared as a big-endian number.
ID_BYTES = 16
GROUP = 20
HEAD_TURNS = 3
# A run is one tree in a task's memory.
RUN_KEYS = 20_000
RUN_BYTES = 32_000_000
_IDS_PER_PIECE = 4096


class Node:
    """A node with a compressed path and its children by the next byte.

    The layout of the children grows with their number: up to 4 and up to 16 sorted bytes beside a list, up to
    48 an index of 256 bytes into a list, beyond that 256 places.
    """

    __slots__ = ("path", "keys", "kids", "count", "least", "words", "ends", "index")

    def __init__(self, path: bytes, words):
        self.path, self.words = path, words
        self.keys, self.kids, self.index = bytearray(), [], None
        self.count, self.least, self.ends = 0, None, []

    @property
    def layout(self) -> int:
        if self.keys is None:
            return 48 if self.index is not None else 256
        return 4 if len(self.keys) <= 4 else 16

    def child(self, byte: int):
        if self.keys is not None:
            at = self.keys.find(byte)
            return None if at < 0 else self.kids[at]
        if self.index is not None:
            at = self.index[byte]
            return None if at == 255 else self.kids[at]
        return self.kids[byte]

    def put(self, byte: int, node) -> None:
        """Add a child or change the one of this byte."""
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = node
            elif len(self.keys) < 16:
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
            else:
                self.index = bytearray(b"\xff" * 256)
                for at, known in enumerate(self.keys):
                    self.index[known] = at
                self.keys = None
                self.put(byte, node)
        elif self.index is not None:
            if self.index[byte] != 255:
                self.kids[self.index[byte]] = node
            elif len(self.kids) < 48:
                self.index[byte] = len(self.kids)
                self.kids.append(node)
            else:
                places = [None] * 256
                for known, at in enumerate(self.index):
                    if at != 255:
                        places[known] = self.kids[at]
                places[byte] = node
                self.index, self.kids = None, places
        else:
            self.kids[byte] = node

    def children(self) -> list:
        return [kid for kid in self.kids if kid is not None]


class RadixTree:
    """Keys of whole turn ids; every node knows how many keys run through it and the smallest name of them."""

    def __init__(self):
        self.root = Node(b"", None)

    @staticmethod
    def _pass(node: Node, name: int) -> None:
        node.count += 1
        if node.least is None or name < node.least:
            node.least = name

    def insert(self, key: bytes, name: int, words) -> None:
        """``words``: the words of each turn of the key."""
        node, at, above = self.root, 0, None
        while True:
            path = node.path
            if not key.startswith(path, at):
                # The path splits: a new node takes the part that agrees.
                rest = key[at : at + len(path)]
                agree = next((i for i, (x, y) in enumerate(zip(path, rest)) if x != y), len(rest))
                upper = Node(path[:agree], node.words)
                upper.count, upper.least = node.count, node.least
                node.path = path[agree:]
                upper.put(node.path[0], node)
                above.put(path[0], upper)
                node, path = upper, upper.path
            self._pass(node, name)
            at += len(path)
            if at == len(key):
                node.ends.append(name)
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:], words)
                self._pass(leaf, name)
                leaf.ends.append(name)
                node.put(key[at], leaf)
                return
            node, at, above = below, at, node


def _digest(names: list) -> str:
    return hashlib.sha256(",".join(map(str, names)).encode()).hexdigest()


NODES = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, node binary, parent binary, words long, run long, side int, "
    "first_end long, ends string"
)
# Rows of a run: nodes with all their members in it, shares of nodes that other runs may hold too, the places
# of those on the two edges of the run, and their ends.
_WHOLE, _SHARE, _EDGE, _ENDS = 0, 1, 2, 3
_NAMES = [field.split(" ")[0] for field in NODES.split(", ")]


def _prefixes(key: bytes) -> list[bytes]:
    """Names of all prefixes of the key, from the empty one: a running hash."""
    hasher, names = hashlib.sha256(), []
    for at in range(0, len(key) + 1, ID_BYTES):
        names.append(hasher.digest()[:ID_BYTES])
        hasher.update(key[at : at + ID_BYTES])
    return names


def _run_rows(tree: RadixTree, first: bytes, last: bytes, run: int) -> list[tuple]:
    """Rows ``NODES`` of a tree whose smallest and largest keys are ``first`` and ``last``.

    Other runs hold keys below the first or above the last, so only prefixes of these two can be shared.
    """
    edges = [_prefixes(first), _prefixes(last)]
    rows = []
    for side, names in enumerate(edges):
        for depth, name in enumerate(names):
            parent = names[depth - 1] if depth else None
            rows.append((_EDGE, None, depth, None, None, None, None, None, None, name, parent, None, run, side, None, None))

    def edge_of(key: bytes, on: int, depth: int) -> int:
        """Bits of the edges that still hold the first ``depth`` turns of a path on edges ``on`` above."""
        end = depth * ID_BYTES
        start = end - ID_BYTES
        return sum(1 << s for s, e in enumerate((first, last)) if on >> s & 1 and len(e) >= end and e[start:end] == key)

    # Downwards: (node, its turns above, the bytes of a turn begun above, edges above, names above).
    order, stack = [], [(tree.root, 0, b"", 3, None, None)]
    while stack:
        node, depth, begun, on, least_above, name_above = stack.pop()
        data = begun + node.path
        turns = len(data) // ID_BYTES
        steps = []
        if node is tree.root:
            steps.append((0, on, None, None))
            least_above, name_above = node.least, edges[0][0]
        for i in range(turns):
            depth += 1
            on = edge_of(data[i * ID_BYTES : (i + 1) * ID_BYTES], on, depth) if on else 0
            # The parent's name matters where it is shared; its smallest member where it is whole.
            steps.append((depth, on, least_above, name_above))
            least_above = None if on else node.least
            name_above = edges[0 if on & 1 else 1][depth] if on else None
        order.append((node, steps))
        rest = data[turns * ID_BYTES :]
        for kid in node.children():
            stack.append((kid, depth, rest, on, least_above, name_above))

    # Upwards: of each node the subtree's whole leaves and savings, and the turn nodes right below it.
    below: dict[int, list[int]] = {}
    for node, steps in reversed(order):
        leaves = saved = kids = shared_kids = 0
        for kid in node.children():
            n, s, top, shared = below.pop(id(kid))
            leaves, saved, kids, shared_kids = leaves + n, saved + s, kids + top, shared_kids + shared
        ends = sorted(node.ends)
        for depth, on, least_above, name_above in reversed(steps):
            words = int(node.words[depth - 1]) if depth else 0
            if on:
                name = edges[0 if on & 1 else 1][depth]
                rows.append((_SHARE, node.least, depth, None, node.count, kids, leaves, saved, None, name, name_above, words, run, None, None, None))
                for at in range(0, len(ends), _IDS_PER_PIECE):
                    some = ends[at : at + _IDS_PER_PIECE]
                    rows.append((_ENDS, None, depth, None, None, None, None, None, None, name, None, None, run, None, some[0], ",".join(map(str, some))))
                kids, shared_kids = 0, 1
            else:
                own = (node.count - 1) * words
                leaves, saved = leaves or 1, saved + own
                rows.append((_WHOLE, node.least, depth, least_above, node.count, kids + shared_kids, leaves, saved, _digest(ends), None, name_above, None, run, None, None, None))
                kids, shared_kids = 1, 0
            ends = []
        below[id(node)] = [leaves, saved, kids, shared_kids]
    return rows


def _runs(run_keys: int, run_bytes: int):
    def build(batches):
        run = TaskContext.get().partitionId() << 32
        tree, first, last, keys, size = RadixTree(), None, None, 0, 0
        for batch in batches:
            for name, key, words in zip(batch["conv_id"], batch["key"], batch["words"]):
                key = bytes(key)
                if first is None:
                    first = key
                last = key
                tree.insert(key, int(name), words)
                keys, size = keys + 1, size + len(key)
                if keys >= run_keys or size >= run_bytes:
                    yield pd.DataFrame(_run_rows(tree, first, last, run), columns=_NAMES).astype(_KINDS)
                    run, tree, first, keys, size = run + 1, RadixTree(), None, 0, 0
        if first is not None:
            yield pd.DataFrame(_run_rows(tree, first, last, run), columns=_NAMES).astype(_KINDS)

    return build


_KINDS = {name: "Int64" for name, kind in (f.split(" ") for f in NODES.split(", ")) if kind in ("long", "int")}


def rebuilt(turns: DataFrame, group: int = GROUP, head_turns: int = HEAD_TURNS) -> DataFrame:
    """(conv_id, key, words) per conversation: its turn ids in one byte string and the words of each turn.

    Turns stand in order of ``turn``, nulls first, equal ones by role and hash; null roles and texts are empty.
    The first ``crc32(id) % (head_turns + 1)`` turns come from conversation ``id - id % group``, if there is
    one (the remainder has the sign of the id, as in SQL). Rows without a conversation id belong to none. Texts stay where
    they are: a turn moves as 16 bytes of its hash and a word count; a conversation is one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    small = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.substring(hashed, 1, 2 * ID_BYTES).alias("id"),
            F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
        ).alias("t"),
    )
    own = small.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    own = staged(own.select("conv_id", F.transform("own", lambda t: F.struct(t["id"], t["words"])).alias("own")), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (head_turns + 1)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, head_turns).alias("head")
    )
    joined = own.withColumns({"base": base, "taken": taken.cast("int")}).join(heads, "base", "left")
    front = F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.slice("own", 1, 0))
    back = F.slice("own", F.col("taken") + 1, F.size("own"))
    whole = joined.select("conv_id", F.concat(front, back).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), "turns.words")


def _joined_ends(batches):
    """Rows (node, first_end, ends) come sorted: one digest per node, of its pieces one after the other."""
    held, hasher = None, None
    for batch in batches:
        done = []
        for node, piece in zip(batch["node"], batch["ends"]):
            if node != held:
                if held is not None:
                    done.append((held, hasher.hexdigest()))
                held, hasher = node, hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(piece.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if held is not None:
        yield pd.DataFrame([(held, hasher.hexdigest())], columns=["node", "ends_sha256"])


def prefix_nodes(
    turns: DataFrame, run_keys: int = RUN_KEYS, run_bytes: int = RUN_BYTES, n_ranges: int | None = None
) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see ``rebuilt``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest
    member, the turns of the prefix, the smallest member of the parent (null for the root), members, next
    turns, childless nodes of the subtree, the sum over the subtree of (members - 1) times the words of the
    last turn, and the SHA-256 of the ids that end here. No conversations give no rows.

    Conversations are sorted by key and id into ranges, so copies of one conversation are split like any
    others. A task builds one radix tree per run of ``run_keys`` keys or ``run_bytes`` bytes. Only prefixes of
    the first and last key of a run can go on in another run: their shares are added up by Spark, and their
    own values reach the nodes above along the edges of the runs. All other nodes are whole in the task.
    """
    keys = rebuilt(turns)
    order = ["key", "conv_id"]
    ranges = keys.repartitionByRange(n_ranges, *order) if n_ranges else keys.repartitionByRange(*order)
    rows = staged(ranges.sortWithinPartitions(*order).mapInPandas(_runs(run_keys, run_bytes), NODES), "trie-runs")
    whole = rows.filter(F.col("kind") == _WHOLE)
    shared = rows.filter(F.col("kind") == _SHARE).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.max("words").alias("words"),
    )
    shared = staged(shared, "trie-shared")
    kids = shared.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    shared = shared.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    # Own values of shared nodes, each at one of the edges it lies on, summed from the deep end of that edge.
    edges = rows.filter(F.col("kind") == _EDGE).select("run", "side", "depth", "node")
    one = edges.groupBy("node").agg(F.min(F.struct("run", "side")).alias("at"))
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    own = shared.select("node", leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("own")).join(one, "node")
    placed = edges.join(own, "node")
    here = F.struct("run", "side") == F.col("at")
    down = Window.partitionBy("run", "side").orderBy(F.col("depth").desc())
    sums = placed.select(
        "node",
        F.sum(F.when(here, F.col("leaf")).otherwise(0)).over(down).alias("leaves"),
        F.sum(F.when(here, F.col("own")).otherwise(0)).over(down).alias("saved"),
    )
    sums = sums.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    pieces = rows.filter(F.col("kind") == _ENDS).select("node", "first_end", "ends")
    sorted_pieces = pieces.repartition("node").sortWithinPartitions("node", "first_end")
    ends = sorted_pieces.mapInPandas(_joined_ends, "node binary, ends_sha256 string")
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = shared.join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left")
    merged = merged.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    inner = whole.filter("parent is null").select(*columns)
    tops = whole.filter("parent is not null").drop("parent_conv_id").join(parents, "parent")
    return inner.unionAll(tops.withColumnRenamed("above", "parent_conv_id").select(*columns)).unionAll(merged)
