"""Spelling variants: words one edit apart, found through chunks that an edit leaves whole.

Of two words that differ by one edit the shorter one (or, of equal lengths, the
first) gives two disjoint chunks, its halves; the other gives the grams that can
meet them: those at the chunks' places, moved by what it is longer.  One edit
spares one of the halves, which meets its gram.  Where a chunk is so common that
too many pairs would meet, what is left beside it differs by one edit too and is
cut into two chunks again, until few words share a place or a single character is
left, which no more words can share than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.llm.shared import drop, written

#: Least code points of a word, and least occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times more often a form occurs than its variant.
RATIO = 10
#: One of so many (run, document) hashes loses a character.
NOISE = 31
#: Different words that a task counts before it sends them.
HELD_WORDS = 200_000
#: Most pairs that meet by one key before it is cut further, and cuts that come first in any case.
KEY_PAIRS, FIRST_CUTS = 10_000, 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """word, n: how often each word of at least ``least_length`` code points occurs in all texts.

    A word is a maximal run of Latin letters with A-Z in lower case; where ``noise``
    divides the hash h of doc_id and run, it is without its character h % length.
    A null doc_id counts as an empty one; a null text has no words; repeated rows
    count each time.  Only doc_id and text are read.  Tasks count runs by document
    and words over documents before they send them, so common words shrink early.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for b in batches:
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                if not text.is_valid:
                    continue
                lower = text.as_buffer().to_pybytes().translate(_LOWER).decode()
                for word, n in Counter(m[0] for m in runs.finditer(lower)).items():
                    h = zlib.crc32(f"{doc_id}:{word}".encode())
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]  # noqa: PLW2901
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice, with one half of what is left as a further part of its key and the other half left; rows with one character left stay."""
    middle = F.expr("CAST((lo + hi) DIV 2 AS INT)")
    chunk = lambda start, n: F.substring(F.col("word"), start + 1, n)
    keyed = lambda half, text, lo, hi: F.struct(F.xxhash64("key", F.lit(half), text).alias("key"), lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    left = keyed("left", chunk(lo, F.col("middle") - lo), F.col("middle"), hi)
    right = keyed("right", chunk(F.col("middle") + F.col("longer"), hi - F.col("middle")), lo, F.col("middle"))
    both = F.when(hi - lo > 1, F.array(left, right)).otherwise(F.array(F.struct("key", "lo", "hi")))
    return rows.withColumn("middle", middle).select("word", "n", "is_gram", "longer", F.explode(both).alias("cut")).select("word", "n", "is_gram", "longer", "cut.*")


def near_pairs(words: DataFrame, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """a, a_n, b, b_n: every pair of words of (word, n), each word there once, that differ by exactly one inserted, deleted or replaced code point; each pair once.

    A key whose chunks and grams would make more than ``key_pairs`` pairs is cut
    further instead of joined, and loses none of its pairs.
    """
    size = F.length("word")
    side = lambda is_gram, longer: words.select("word", "n", F.lit(is_gram).alias("is_gram"), F.lit(longer).alias("longer"), F.xxhash64(size - longer).alias("key"), F.lit(0).alias("lo"), (size - longer).alias("hi"))
    rows = side(False, 0).unionByName(side(True, 0)).unionByName(side(True, 1).filter("hi > 0"))
    found, used = [], []
    for _ in range(FIRST_CUTS - 1):
        rows = _cut(rows)
    while True:
        rows = written(_cut(rows))
        used.append(rows)
        count = lambda is_gram: F.count(F.when(F.col("is_gram") == is_gram, 1))
        meet = rows.groupBy("key").agg((count(False) * count(True)).alias("pairs"), F.max(F.col("hi") - F.col("lo")).alias("left"))
        hot = written(meet.filter((F.col("pairs") > key_pairs) & (F.col("left") > 1)).select("key"))
        used.append(hot)
        cold = rows.join(hot, "key", "left_anti")
        chunks = cold.filter("NOT is_gram").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        grams = cold.filter("is_gram").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        near = ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
        found.append(written(chunks.join(grams, "key").filter(near).select("a", "a_n", "b", "b_n").distinct()))
        if hot.isEmpty():
            break
        rows = rows.join(hot, "key", "left_semi")
    drop(*used)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct() if len(found) > 1 else pairs


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the last word that forms lead to.  Each round doubles the way; counts grow along it, so there are no cycles."""
    rows = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(rows.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(rows)
        rows = step
        if rows.filter("moved").isEmpty():
            return rows.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of (word, n), each word there once.

    A form is the near word of largest n, of equal ones the first by code points,
    if it occurs at least ``ratio`` times as often (more than once).
    """
    if ratio < 2:  # else two words could be each other's form
        raise ValueError("a form must be more common than its variant")
    pairs = near_pairs(words)
    half = lambda a, b: pairs.select(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = half("a", "b").unionByName(half("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    rows = written(rows)
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """The variants among all words of ``documents`` that occur at least ``least_count`` times; no documents give no rows."""
    return variants(written(word_counts(documents).filter(F.col("n") >= least_count)))
