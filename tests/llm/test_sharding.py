import zlib
from collections import Counter

from parcelgraph.llm import sharding
from tests.llm.conftest import DOCS, awkward_rows, passage


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_awkward_rows(awkward):
    check(awkward_rows(), sharding.shard(awkward, 5).collect(), 5)


def test_empty_table(empty):
    assert sharding.shard(empty).collect() == []


def test_sizes_are_nearly_equal_with_a_hot_text(spark):
    rows = [(i, passage(i % 40, 60 + i % 17), ("en", "de")[i % 2], "abcde"[i % 5], None) for i in range(1500)] + [(5000 + i, passage(99, 70), "en", "hot", None) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 24).collect()
    check(rows, got, 24)
    weight = Counter()
    for r in got:
        weight[r["shard"]] += r["size"]
    assert len(weight) == 24 and max(weight.values()) - min(weight.values()) < 0.06 * max(weight.values())


def test_every_node_is_cut_at_the_weighted_median_of_its_widest_dimension(spark):
    """The leaves' numbers say the path to each row, so every inner node can be looked at: its goal by brute force from the rows that reached it."""
    rows = [(i * i, passage(i % 60, 20 + i % 31), ("en", "de", "fr")[i % 3], "abcde"[i % 5], None) for i in range(700)]
    tree, _ = sharding.kd_tree(sharding.measured(spark.createDataFrame(rows, DOCS)), 6)
    found = [r.asDict() for r in tree.collect()]
    shards = {1: 6}
    for node in range(1, 32):
        if shards.get(node, 1) == 1:
            continue
        k = shards[node]
        shards |= {2 * node: k // 2, 2 * node + 1: k - k // 2}
        at = node.bit_length()
        own = [(f"{r['node']:b}", r) for r in found if f"{r['node']:b}".startswith(f"{node:b}")]
        left, right = ([r for path, r in own if path[at] == side] for side in "01")
        assert len(left) + len(right) == len(own) > 0
        goal = sum(r["size"] for _, r in own) * (k // 2) / k
        assert abs(sum(r["size"] for r in left) - goal) <= max(r["size"] for _, r in own)
        spread = {d: max(r[d] for _, r in own) - min(r[d] for _, r in own) for d in sharding.DIMENSIONS}
        widest = max(sharding.DIMENSIONS, key=lambda d: spread[d])
        step = spread[widest] / sharding.BINS
        assert max(r[widest] for r in left) <= min(r[widest] for r in right) + step
