import hashlib

from parcelgraph.llm import substring
from tests.llm.conftest import DOCS, awkward_rows, passage


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 19):
            if doc_id is not None:
                first.setdefault(tuple(w[i : i + 20]), (doc_id, i))
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if doc_id is not None and first[tuple(w[i : i + 20])] != (doc_id, i):
                gone[i : i + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substring.remove_repeats(df).collect()), key=repr)


def test_awkward_rows_against_brute_force(awkward):
    assert found(awkward) == brute([r[:2] for r in awkward_rows()])


def test_empty_table(empty):
    assert found(empty) == []


def test_repeats_within_and_across_documents(spark):
    shared, own = passage(7, 60), passage(8, 25)
    texts = [f"{passage(20 + i, 30 + i)} {shared} {passage(40 + i, 10)}" for i in range(8)] + [f"{own} {own} {own}", own, " ".join(["x"] * 45), "x " * 19]
    rows = [(90 - 7 * i, t, "en", "a", None) for i, t in enumerate(texts)]
    assert found(spark.createDataFrame(rows, DOCS)) == brute([r[:2] for r in rows])


def test_intervals_are_maximal(spark):
    shared = passage(7, 60)
    rows = [(1, shared, None, None, None), (2, f"a b {shared} c", None, None, None)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed"]] for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [], 2: [(2, 62)]}
