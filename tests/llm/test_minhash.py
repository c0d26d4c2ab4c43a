from math import comb

import numpy as np
from pyspark.sql import functions as F

from parcelgraph.llm import minhash
from tests.llm.conftest import DOCS, awkward_rows, passage

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((r[0], len(sets[i]), component, component == r[0]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).drop("text_key").collect()), key=repr)


def test_awkward_rows_against_brute_force(awkward):
    assert found(awkward) == brute(awkward_rows())


def test_empty_table(empty):
    assert found(empty) == []


def test_chains_and_groups_against_brute_force(spark):
    rows = []
    for g in range(6):
        words = passage(200 + g, 80).split()
        for i in range(12):
            words = words.copy()
            words[(i * 7) % 80] = f"edit{i % (g + 1)}"
            rows.append((1000 * g + i, " ".join(words), "en", "a", None))
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_sketches_estimate_similarity_and_never_stay_empty():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 50, 1000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 4 // 5], rng.integers(0, 1 << 63, n - n * 4 // 5, dtype=np.uint64)])
        s = minhash.sketches([a, b], np.array([n, n]))
        assert (s != minhash._EMPTY).all()
        similarity = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - similarity) < (0.12 if n >= 50 else 1.1)


def test_representatives_keep_one_of_each_group(awkward):
    kept = sorted(r["doc_id"] for r in minhash.representatives(awkward).collect() if r["doc_id"] is not None)
    assert kept == sorted({r[0] for r in brute(awkward_rows()) if r[3] and r[0] is not None})
    assert len(kept) == len(set(kept))


def test_representatives_with_clashing_columns_and_repeated_ids(spark):
    a, b = passage(7, 60), passage(8, 60)
    rows = [(1, a, "x", 1, True), (1, a, "y", 2, True), (1, b, "z", 3, False), (None, b, "z", 4, None), (None, None, "z", 5, None), (None, None, "w", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, id long, no_id boolean")
    got = minhash.representatives(docs)
    assert got.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(found) == 2 and sorted(found, key=repr)[0][0] == 1 and (None, None) in found


def test_traces_never_rule_out_a_link(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for i in range(400):
        n = int(rng.integers(1, 2000 if i % 4 == 0 else 200))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[int(n * rng.uniform(0, 0.3)) :][:n])
        both = len(np.intersect1d(a, b))
        pairs.append((len(a), len(b), both / (len(a) + len(b) - both), *minhash.traces([a, b], np.array([len(a), len(b)])).tolist()))
    rows = spark.createDataFrame(pairs, "n long, m long, similarity double, a array<long>, b array<long>")
    got = [(r["similarity"], r["n"], r["may"]) for r in rows.select("similarity", "n", minhash.may_link((F.col("n"), F.col("m")), (F.col("a"), F.col("b"))).alias("may")).collect()]
    assert all(may for x, _, may in got if x >= 0.75) and sum(x >= 0.75 for x, _, _ in got) > 50
    assert not any(may for x, n, may in got if x < 0.6 and 20 <= n < 200)  # larger sets fill their traces


def test_estimate_loses_no_more_than_the_banding():
    """Unequal bits of two sketches at similarity 0.75: a bin differs with 0.25, each of its bits then with 0.5."""
    one = np.array([0.25 * comb(minhash.BITS, i) / 2**minhash.BITS for i in range(minhash.BITS + 1)])
    one[0] += 0.75
    unequal = np.array([1.0])
    for _ in range(minhash.COORDINATES):
        unequal = np.convolve(unequal, one)
    estimate = 1 - 2 * np.arange(len(unequal)) / (minhash.BITS * minhash.COORDINATES)
    assert unequal[estimate < minhash.LEAST_ESTIMATE].sum() <= (1 - 0.75**minhash.ROWS) ** minhash.BANDS
