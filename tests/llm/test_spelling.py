import random
import re
import zlib
from collections import Counter

import pytest

from parcelgraph.llm import spelling
from tests.llm.conftest import DOCS, awkward_rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            if len(low) >= 7:
                found[low] += 1
    return {w: n for w, n in found.items() if n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, words, **more):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(df, **more).collect())


def edited(r, word):
    at, c = r.randrange(len(word) + 1), r.choice("abéÿ")
    return r.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


def test_awkward_documents(spark, awkward):
    rows = awkward_rows()
    got = sorted(tuple(r) for r in spelling.spelling_variants(awkward).collect())
    assert got == brute(counts(rows))


def test_runs_of_all_letters(spark):
    rows = [(i, "Éléphant ÉLÉPHANT élephant éléphants Straße×Straßenbahn Straßenbahnen naïveté÷ab " * (i + 1) + "A" * 40 + " " + "x" * 70_000, "en", "a", None) for i in range(70)]
    got = sorted(tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute(counts(rows))


def test_no_rows(spark, empty):
    assert spelling.spelling_variants(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_words(spark, seed):
    r = random.Random(seed)
    words = {}
    for _ in range(120):
        word = "".join(r.choice("abcé") for _ in range(r.randrange(7, 13)))
        for step in range(r.randrange(1, 6)):
            words[word] = 10 ** r.randrange(0, 4) * r.randrange(1, 12)
            word = edited(r, word)
    words = {w: n for w, n in words.items() if len(w) >= 2}
    assert found(spark, words) == brute(words)


def test_common_chunks_are_cut_further(spark):
    """Keys of one pair at most: nearly everything is cut down to a character."""
    r = random.Random(5)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(7, 10))): r.randrange(1, 300) for _ in range(150)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted((x["a"], x["b"]) if x["a"] < x["b"] else (x["b"], x["a"]) for x in spelling.near_pairs(df, key_pairs=1).collect())
    assert got == sorted((a, b) for a in words for b in words if a < b and is_near(a, b))


def test_one_stem_for_all(spark):
    words = {"commonstem" + a + b: 1 for a in "abcdefghij" for b in "abcdefghij"} | {"commonstem": 5000, "commonstema": 100}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {tuple(sorted((x["a"], x["b"]))) for x in spelling.near_pairs(df, key_pairs=20).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and is_near(a, b)}
    assert found(spark, words) == brute(words)


def test_a_chain_of_forms(spark):
    words = {"abcdefg" + "h" * k: 10**k for k in range(9)}
    assert found(spark, words) == brute(words)
    assert {row[2] for row in found(spark, words)} == {"abcdefg" + "h" * 8}
