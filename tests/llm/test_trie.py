import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from parcelgraph.llm import trie

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType())])


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (c % 100 if c >= 0 else -(-c % 100))
        full = turns.get(block, [])[:h] + mine[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append((c, len(full) == d))
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        children = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c, end in who if end)))
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        out.append((min(c for c, _ in who), len(path), parent, len(who), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    """Few different turns, so that conversations share much; ids of several families, some without a first one."""
    r, rows = random.Random(seed), []
    for _ in range(n):
        conv = r.choice([0, 100, 300, -100]) + r.randrange(100)
        if any(x[0] == conv for x in rows):
            continue
        for turn in range(r.randrange(1, 12)):
            rows.append((conv, r.choice([None, turn]) if turn == 0 else turn, r.choice(["user", "user", None]), r.choice(["a", "a", "bé日", "", None]), "x"))
    return rows


def found(df, shard_turns):
    return sorted((tuple(x) for x in trie.trie_nodes(trie.rebuilt_conversations(df), shard_turns).collect()), key=repr)


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 10**6), (2, 7), (3, 2), (4, 30)])
def test_against_brute_force(spark, seed, shard_turns):
    rows = conversations(seed, 150)
    assert found(spark.createDataFrame(rows, ROWS), shard_turns) == brute(rows)


def test_copies_over_many_shards(spark, monkeypatch):
    """A path that most conversations share, with others below it and beside it."""
    monkeypatch.setattr(trie, "IDS_A_ROW", 3)
    rows = [(c, t, "user", "same", "x") for c in range(1, 90) for t in range(3)]
    rows += [(c, t, "user", x, "x") for c in range(101, 105) for t, x in enumerate(["same", "same", "same", "more", "last"])]
    rows += [(c, 0, "user", "other", "x") for c in range(201, 205)]
    assert found(spark.createDataFrame(rows, ROWS), 5) == brute(rows)


def test_a_long_conversation_and_a_short_one(spark):
    rows = [(7, t, "user", f"t{t % 5}", "x") for t in range(3000)] + [(107, t, "user", f"t{t % 5}", "x") for t in range(2000)]
    h = [zlib.crc32(str(c).encode()) % 6 for c in (7, 107)]
    got = found(spark.createDataFrame(rows, ROWS), 10)
    assert max(x[1] for x in got) == 3000 - h[0]
    root = next(x for x in got if x[1] == 0)
    assert root[3:6] == (2, len({f"t{k % 5}" for k in h}), len([1 for x in got if x[4] == 0]))


def test_turnless_null_and_repeated_rows(spark):
    """Ties of turn go by codes, which the brute force doesn't know: all its ties are repeated rows."""
    rows = [(c, 0, "user", "x", "x") for c in range(1, 40)] + [(None, 0, "user", "x", "x")] * 2 + [(60, 1, None, None, "x")] * 7 + [(61, None, None, "y", "x")] * 2
    assert found(spark.createDataFrame(rows, ROWS), 3) == brute(rows)


def test_no_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], ROWS)).collect() == []


def test_close_of_against_a_stack():
    for n in (1, 2, 33, 64, 400):
        for seed in range(20):
            r, bits, depth, left = random.Random(seed), [], 0, n
            while left or depth:
                if depth == 0 or (left and r.random() < (0.5, 0.9, 0.2)[seed % 3]):
                    bits.append(True)
                    depth, left = depth + 1, left - 1
                else:
                    bits.append(False)
                    depth -= 1
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            assert list(trie.close_of(np.array(bits))) == [want[k] for k in sorted(want)]
