import numpy as np
from pyspark.sql import functions as F

from parcelgraph.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, score double, label int"


def brute(rows, top):
    good = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, v), v)
    good = {i: np.array(v, np.float32).astype(float) for i, v in good.items()}
    out = {}
    for q in good:
        if q % 20 == 0:
            best = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:top]
            out[q] = [(i, -s) for s, i in best]
    return out


def search(spark, rows, top=20):
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, top).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()}


def test_awkward_vectors_all_candidates(spark):
    rows = [(20, [1.0, 0.0, 2.0], 0.5, 1), (21, [1.0, 0.0, 2.0], None, None), (3, [1.0, 0.0, 2.0], None, 1), (4, None, None, 1), (5, [0.0, 0.0, 0.0], None, 1), (6, [1.0, None, 0.0], None, 1), (7, [float("nan"), 1.0, 0.0], None, 1), (8, [float("inf"), 1.0, 0.0], None, 1), (None, [1.0, 1.0, 1.0], None, 1), (9, [5.0, 5.0, 5.0], None, 1), (10, [1.0], None, 1), (9, [5.0, 5.0, 5.0], None, 1), (40, [-1.0, 0.5, 0.0], None, 1), (60, [], None, 1)]
    assert search(spark, rows) == brute(rows, 20)


def test_a_query_meets_the_rows_of_its_own_dimension(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(2 + i % 3)], None, None) for i in range(120)] + [(1001, [1.0] * 9, None, None)]
    got, expected = search(spark, rows), brute(rows, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in expected.items()}
    assert set(got) == {0, 20, 40, 60, 80, 100}


def test_large_components(spark):
    rows = [(i, [1e200 * (i + 1), 1.0], None, None) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, label int")
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert len(got) == 10 and {r["query_id"] for r in got} == {0, 20}


def test_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    v[500:900] = v[500]
    rows = [(i, [float(x) for x in r], None, None) for i, r in enumerate(v)]
    expected, got = brute(rows, 20), search(spark, rows)
    assert set(got) == set(expected) and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 20 * len(expected)
    exact = {i: np.float32(r).astype(float) for i, r in enumerate(v)}
    assert all(abs(s - exact[q] @ exact[i]) < 1e-9 for q, x in got.items() for i, s in x)


def test_empty_table(spark):
    assert search(spark, []) == {}
