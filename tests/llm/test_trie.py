import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members
    )


def told(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in trie.trie(df).collect())


def talks(seed, n, words=3):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.1:
            continue
        for k in range(draw.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, k, draw.choice(["user", "bot", None]), draw.choice(["é" * draw.randint(1, words), "hello", None, ""])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_brute_force_over_many_shards(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_ROWS", 7)
    rows = talks(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "shard": F.lit(1), "key": F.lit(2), "c": F.lit(3)})
    assert told(df.repartition(5)) == brute(rows)


def test_a_hot_conversation_and_a_long_one(spark, monkeypatch):
    """A third of all conversations are the same; their members are more than a block holds."""
    monkeypatch.setattr(trie, "SHARD_ROWS", 5)
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = talks(8, 120) + [(c, k, "user", f"t{k}") for c in range(200, 320) for k in range(3)] + [(400, k, "user", "z") for k in range(300)] + [(405 + c, k, "user", "z") for c in range(3) for k in range(290)]
    assert told(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (0, None, "user", "first"), (0, 0, None, None), (0, 1, "user", "x"), (2, 0, "us", "erx"), (7, 0, "user", "x"), (5, 0, "user", "x")]
    assert told(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    same = [(3, 1, "a", "b")] * 12 + [(4, 1, "a", "b")] * 12
    assert told(spark.createDataFrame(same, SCHEMA)) == brute(same)
    assert told(spark.createDataFrame([], SCHEMA)) == []
    assert told(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
