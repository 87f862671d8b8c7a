"""op13 against plain Python dictionaries, on many small runs and ranges."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pricemill.llm import turn_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in given.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
    return sorted(
        (
            (
                min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n],
                hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
            )
            for n, m in members.items()
        ),
        key=repr,
    )


def got(df):
    assert dict(df.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def conversations(seed, n, texts, most):
    draw = random.Random(seed)
    return [
        (c, turn, draw.choice(["user", "assistant"]), " ".join(draw.choices(texts, k=2)))
        for c in range(n)
        for turn in range(draw.randrange(1, most))
        if draw.random() < 0.95
    ]


@pytest.mark.parametrize("run_keys, n_ranges", [(1, 1), (3, 4), (1000, 7), (1000, 1)])
def test_trie_of_random_conversations(spark, run_keys, n_ranges):
    rows = conversations(run_keys, 150, ["a", "b"], 7) + [(500 + i, 0, "user", f"one of many {i}") for i in range(300)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(turn_trie.prefix_nodes(turns, run_keys, n_ranges=n_ranges)) == brute(rows)


def test_copies_of_one_conversation_are_split(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(1, 401) for t in range(3)] + [(21, 3, "user", "more")]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert got(turn_trie.prefix_nodes(turns, 16, n_ranges=5)) == brute(rows)


def test_odd_turns(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, 1, "", ""), (0, 0, "user", "a  b\tc"), (7, None, "user", "x"),
        (7, None, "user", "w"), (7, 2, "user", None), (9, 1, "user", "x" * 100_000), (20, 1, "u", "ser"), (21, 1, "us", "er"),
        (45, 0, "user", "only"), (46, 0, "user", "only"), (-3, 0, "user", "below zero"), (0, 1, "", ""), (9, 1, "user", "é 日本"),
    ]
    rows += [(60, t, "user", f"turn {t % 5}") for t in range(400)] + [(61, t, "user", f"turn {t % 5}") for t in range(399)]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "words": F.lit("x"), "own": F.lit(2)})
    own = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    # Equal places stand by hash, so the fixture has none that differ beyond conversation 7 and 9.
    want = brute([r for r in own if r[0] not in (7, 9)])
    small = turns.filter("conv_id is null or conv_id not in (7, 9)")
    for run_keys in (1, 2, 100):
        assert got(turn_trie.prefix_nodes(small, run_keys)) == want
    # Ties: some order, the same each time.
    assert got(turn_trie.prefix_nodes(turns)) == got(turn_trie.prefix_nodes(turns.repartition(5)))


def test_no_conversations_give_no_rows(spark):
    assert got(turn_trie.prefix_nodes(spark.createDataFrame([], SCHEMA))) == []
    assert got(turn_trie.prefix_nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    # Conversation 3 of no base: its first turns go and none are left.
    lost = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lost, 0, "user", "x"), (lost, 1, "user", "y")]
    want = [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
    assert got(turn_trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA))) == want == brute(rows)


@pytest.mark.parametrize("n", [1, 4, 5, 16, 17, 48, 49, 256])
def test_node_layouts(n):
    node = turn_trie.Node(b"", None)
    order = list(range(n))
    random.Random(n).shuffle(order)
    for byte in order:
        node.put(byte, byte)
        node.put(byte, byte + 1000)
    assert [node.child(b) for b in range(n)] == [b + 1000 for b in range(n)]
    assert all(node.child(b) is None for b in range(n, 256))
    assert sorted(node.children()) == [b + 1000 for b in range(n)]
    assert node.layout == next(size for size in (4, 16, 48, 256) if n <= size)
