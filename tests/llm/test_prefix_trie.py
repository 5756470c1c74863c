from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opsgauge.llm.prefix_trie import prefix_trie, turn_sequences, with_ends_digest, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, block=None, most=0):
    """The nodes of the trie from plain prefixes, sorted."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {conv: [(role, text) for _, _, role, text in sorted(listed)] for conv, listed in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(turns):
        path = tuple(turns[conv])
        if block:
            h = zlib.crc32(str(conv).encode()) % (most + 1)
            head = int(conv - (conv % block if conv >= 0 else -(-conv % block)))
            path = tuple(turns.get(head, [])[:h]) + path[h:]
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
        ends[path].append(conv)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not kids[path]
        if path:
            saved[path] += (len(members[path]) - 1) * len(path[-1][1])
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
            kids[path[:-1]] += 1
    found = []
    for path, ids in members.items():
        above = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        found.append((min(ids), len(path), above, len(ids), kids[path], leaves[path], saved[path], digest))
    return sorted(found, key=repr)


def _result(spark, rows, block=None, most=0, shard_turns=200_000):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sequences = turn_sequences(df)
    if block:
        shared = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)
        sequences = with_shared_heads(sequences, block, shared, most)
    found = with_ends_digest(*prefix_trie(sequences, shard_turns)).drop("node")
    return sorted((tuple(row) for row in found.collect()), key=repr)


def _conversations(count, turns=3, seed=1):
    random.seed(seed)
    rows = []
    for conv in range(count):
        for turn in range(random.randrange(1, 7)):
            rows.append((conv, turn, random.choice(["user", "assistant"]), f"text {random.randrange(turns)}"))
    return rows


@pytest.mark.parametrize("shard_turns", [1, 9, 200_000])
def test_shards_of_any_size_give_the_same_trie(spark, shard_turns):
    rows = _conversations(60)
    # One very common conversation, spread over many shards.
    rows += [(1000 + at, turn, "user", f"text {turn}") for at in range(40) for turn in range(3)]
    assert _result(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_shared_heads(spark):
    rows = _conversations(230, turns=2) + [(-7, 0, "user", "negative"), (905, 0, "user", "no first one")]
    rows = [row for row in rows if row[0] != 100]
    assert _result(spark, rows, 100, 5) == brute(rows, 100, 5)


def test_odd_turns(spark):
    rows = [
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 5, "", ""),
        (2, None, "user", "first"),
        (2, 3, "", None),
        (3, 0, "us", "er"),
        (3, 0, "us", "er"),
        (4, 0, "use", "r"),
        (None, 0, "user", "of nobody"),
        (5, 0, "user", "ä\U0001f600" * 3),
    ]
    assert _result(spark, rows) == brute(rows)


def test_very_long_conversation_and_empty_table(spark):
    rows = [(1, turn, "user", str(turn % 7)) for turn in range(3000)] + [(2, turn, "user", str(turn % 7)) for turn in range(2990)]
    assert _result(spark, rows, shard_turns=100) == brute(rows)
    assert _result(spark, []) == []


def test_ends_are_listed(spark):
    rows = [(conv, 0, "user", "same") for conv in range(9)] + [(20, 0, "user", "other")]
    nodes, ends = prefix_trie(turn_sequences(spark.createDataFrame(rows, SCHEMA)), shard_turns=6)
    listed = [row for row in ends.orderBy("first").collect()]
    assert [conv for row in listed for conv in row.conv_ids if conv < 9] == list(range(9))
    assert all(len(row.conv_ids) <= 3 for row in listed)
    assert nodes.count() == 3
