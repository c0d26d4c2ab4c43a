from collections import Counter

from parcelgraph.llm import decontaminate
from tests.llm.conftest import DOCS, passage


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, items):
    """(doc_id, item_id) with the greatest similarity of any item-sized window that shares a shingle."""
    out = {}
    for item_id, text in items:
        w = (text or "").lower().split()
        own = shingles(w)
        for doc_id, text_ in docs:
            d = (text_ or "").lower().split()
            for s in range(max(1, len(d) - len(w) + 1)):
                other = shingles(d[s : s + len(w)])
                both = sum((own & other).values())
                if both and 100 * both >= 75 * sum((own | other).values()):
                    key = (doc_id, item_id)
                    out[key] = max(out.get(key, 0), both / sum((own | other).values()))
    return out


def test_planted_passages_against_brute_force(spark):
    items = [(i, passage(300 + i, 20 + 3 * i)) for i in range(12)] + [(20, "only three words"), (21, None), (22, ""), (23, passage(301, 23)), (24, "one")]
    docs = []
    for i in range(60):
        words = passage(400 + i, 40 + i).split()
        leak = passage(300 + i % 12, 20 + 3 * (i % 12)).split()
        if i % 3 == 0:
            words[10:10] = leak
        elif i % 3 == 1:
            leak[len(leak) // 2] = "edited"
            words[20:20] = leak
        docs.append((i, " ".join(words)))
    docs += [(100, "say Only  THREE words now"), (101, None), (102, ""), (103, passage(305, 35)), (103, passage(305, 35)), (104, " ".join(passage(306, 38).split()[:30])), (None, passage(305, 35)), (105, "one")]
    rows = [(i, t, "en", "a", None) for i, t in docs]
    bench = spark.createDataFrame([(*x, None) for x in items], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(spark.createDataFrame(rows, DOCS), bench).collect()
    expected = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(expected)
    assert all(abs(r["similarity"] - expected[r["doc_id"], r["item_id"]]) < 1e-9 for r in got)
    assert sum(r["doc_id"] == 103 for r in got) == 2 * len({r["item_id"] for r in got if r["doc_id"] == 103})
    clean = sorted(repr(r["doc_id"]) for r in decontaminate.without_leaks(spark.createDataFrame(rows, DOCS), bench).collect())
    assert clean == sorted(repr(i) for i, _ in docs if not any(i == d for d, _ in expected))


def test_moved_parts_against_brute_force(spark):
    items = [(1, passage(700, 60)), (2, passage(701, 60)), (3, passage(702, 300))]
    docs = []
    for i, (item_id, cut) in enumerate([(1, 30), (2, 20), (3, 100), (1, 0)]):
        w = dict(items)[item_id].split()
        docs.append((i, " ".join([passage(710 + i, 200), *w[cut:], *w[:cut], passage(720 + i, 90)])))
    rows = [(i, t, "en", "a", None) for i, t in docs]
    got = decontaminate.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute(docs, items)
    assert set(expected) == {(0, 1), (1, 2), (2, 3), (3, 1)}
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}


def test_repeated_and_null_item_ids(spark):
    items = [(1, passage(800, 40)), (1, passage(801, 40)), (2, passage(802, 30)), (2, passage(803, 60)), (None, passage(804, 40)), (1, passage(800, 40).upper())]
    texts = [f"{passage(810 + i, 50)} {t} end" for i, (_, t) in enumerate(items[:5])] + [passage(820, 90)]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_words"], r["similarity"]) for r in got) == [(0, 1, 40, 1.0), (1, 1, 40, 1.0), (2, 2, 30, 1.0), (3, 2, 60, 1.0), (4, None, 40, 1.0)]
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()] == [5]


def test_empty_tables(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, passage(2, 120))], "item_id long, text string")
    assert decontaminate.leaks(empty, some).collect() == []
    assert decontaminate.leaks(awkward, none).collect() == []
    assert {r["doc_id"] for r in decontaminate.leaks(awkward, some).collect()} == {1, 2, 3}
    assert decontaminate.without_leaks(awkward, none).count() == awkward.count()


def test_every_fingerprint_within_the_radius_is_found():
    from itertools import combinations

    masks = {sum(1 << b for b in c) for n in range(decontaminate.RADIUS // decontaminate.BLOCKS + 1) for c in combinations(range(decontaminate.BLOCK_BITS), n)}
    spread = [decontaminate.RADIUS // decontaminate.BLOCKS + (i < decontaminate.RADIUS % decontaminate.BLOCKS) for i in range(decontaminate.BLOCKS)]
    assert min(spread) <= decontaminate.RADIUS // decontaminate.BLOCKS and all(m.bit_count() <= 2 for m in masks) and len(masks) == 37
