from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from parcelgraph.llm import mixing, registry
from tests.llm.conftest import DOCS, awkward_rows


def brute_targets(sizes):
    """By raising the level until no excess is left: fix capped sources, share the rest by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_awkward_rows(awkward):
    rows = awkward_rows()
    size = [len((r[1] or "").encode().split()) for r in rows]
    of_source = Counter()
    for r, n in zip(rows, size, strict=True):
        of_source[r[3]] += n
    planned, drawn = mixing.mix(awkward)
    got = mixing.per_document(planned, drawn).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r[0], n) for r, n in zip(rows, size, strict=True) if r[0] is not None)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    expected, taken, longest = brute_targets(of_source), defaultdict(int), Counter()
    for r in planned.collect():
        assert r["source_size"] == of_source[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        taken[r["source"]] += sum(r["taken"])
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - expected[s]) <= longest[s] / 2 + 0.5 for s in expected)
    again = mixing.per_document(*mixing.mix(awkward.repartition(5))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_tree_keeps_quotas_at_every_node(spark):
    quota = {"=a": 300, "=b": 40, "-": 7, "=c": 1}
    for shards in (1, 5, 16):
        levels = mixing.splitting_tree(spark.createDataFrame(list(quota.items()), "source_key string, quota long"), shards)
        tables = [(width, {(r["node"], r["source_key"]): r["quota"] for r in t.collect()}) for width, t in levels]
        assert tables[0][1] == {(1, s): q for s, q in quota.items()}
        for (width, before), (_, after) in zip(tables[:-1], tables[1:], strict=True):
            for n, k in width.items():
                total = lambda t, m: sum(q for (node, _), q in t.items() if node == m)
                if k > 1:
                    assert all(before.get((n, s), 0) == after.get((2 * n, s), 0) + after.get((2 * n + 1, s), 0) for s in quota)
                    assert total(after, 2 * n) == total(before, n) * (k // 2) // k
                else:
                    assert all(before.get((n, s), 0) == after.get((n, s), 0) for s in quota)
        width, leaves = tables[-1]
        assert len(width) == shards and set(width.values()) == {1}
        assert all(sum(q for (_, name), q in leaves.items() if name == s) == quota[s] for s in quota)


def test_split_is_hypergeometric(spark):
    """64 leaves of 5 blocks each: those of the first source vary as draws without replacement, 3 on average."""
    quotas = spark.createDataFrame([("=x", 192), ("=y", 128)], "source_key string, quota long").coalesce(1)
    width, leaves = mixing.splitting_tree(quotas, 64)[-1]
    own = {r["node"]: r["quota"] for r in leaves.filter("source_key = '=x'").collect()}
    split = [own.get(n, 0) for n in width]
    variance = sum((x - 3) ** 2 for x in split) / len(split)
    assert sum(split) == 192 and max(split) <= 5 and 0.6 < variance < 1.9  # 1.18 expected


def test_shards_are_disjoint_and_nearly_equal_in_blocks(awkward):
    _, drawn = mixing.mix(awkward, shards=4)
    leaf = mixing.blocks(drawn.drop("shard"), 4).collect()
    assert len({(r["source_key"], r["epoch"], r["block"]) for r in leaf}) == len(leaf)
    for source in {r["source_key"] for r in leaf}:
        own = sorted((r["rank"], r["shard"]) for r in leaf if r["source_key"] == source)
        assert [x for x, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    counts = Counter(r["shard"] for r in leaf)
    assert max(counts.values()) - min(counts.values()) <= 2
    assert drawn.count() == mixing.draws(mixing.plan(awkward)).count()


def test_shards_are_shuffled_locally(awkward):
    rows = [(r["shard"], r["local_order"], r["row"]["doc_id"]) for r in mixing.shuffled_shards(awkward, shards=3).collect()]
    assert rows == sorted(rows, key=lambda r: r[:2]) and {r[0] for r in rows} == {0, 1, 2}
    assert rows == [(r["shard"], r["local_order"], r["row"]["doc_id"]) for r in mixing.shuffled_shards(awkward.repartition(5), shards=3).collect()]
    own = [x for s, _, x in rows if s == 0]
    assert own != sorted(own, key=lambda x: (x is None, x))


def test_empty_table(empty):
    assert mixing.per_document(*mixing.mix(empty)).collect() == []
    assert mixing.mixed_documents(empty).collect() == []


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, None, "a", None), (2, "", None, "b", None)], DOCS)
    assert {(r["doc_id"], r["target"], r["taken"]) for r in mixing.per_document(*mixing.mix(df)).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_mixed_documents_hold_the_taken_words(awkward):
    words = Counter()
    for r in mixing.mixed_documents(awkward).collect():
        words[r["source"]] += len(r["text"].encode().split())
    taken = Counter()
    for r in mixing.plan(awkward).collect():
        taken[r["source"]] += sum(r["taken"])
    assert words == +taken
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_queries_take_whole_documents(spark, awkward, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    texts, words, longest = {r[1] for r in awkward_rows()}, Counter(), Counter()
    for r in awkward_rows():
        longest[r[3]] = max(longest[r[3]], len((r[1] or "").encode().split()))
    got = corpus_pipeline.mixed(spark, awkward, str(tmp_path)).collect()
    for r in got:
        assert r["text"] in texts
        words[r["source"]] += len(r["text"].encode().split())
    target = {r["source"]: r["target"] for r in mixing.plan(awkward).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - target[s]) <= longest[s] / 2 + 0.5 for s in target)
    taken = registry.op2_mix_sources(spark, str(tmp_path)).collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in taken) and sum(r["taken"] for r in taken) == sum(words.values())
