import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType())])

_WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions under pale moons and count every star twice before dawn".split()


def passage(seed: int, n: int) -> str:
    """``n`` words that depend on the seed."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(_WORDS[(x >> 8) % len(_WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies."""
    long_text = passage(1, 6000)
    base = passage(2, 120)
    near = base.replace(base.split()[60], "changed")
    rows = [
        (1, base, "en", "a", "x"), (2, base, "en", "a", "x"), (3, near, "de", "b", None), (4, None, None, None, None), (5, "", "en", "a", "x"), (6, " \t\n", "fr", "b", "x"),
        (7, "one two three", "en", "c", "x"), (8, "One TWO three", "en", "c", "x"), (9, long_text, "en", None, "x"), (10, long_text + " end", None, "c", "x"), (None, passage(3, 40), "en", "a", "x"),
        (None, None, None, None, None), (11, passage(4, 50), "fr", "c", "x"), (11, passage(4, 50), "fr", "c", "x"), (12, "1234 5678 !!", "en", "a", "x"), (13, "é ü 日本 語", "de", "b", "x"),
    ]
    return rows + [(100 + i, passage(50 + i, 30 + i), ("en", "de", "fr")[i % 3], "abc"[i % 3], "x") for i in range(30)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
