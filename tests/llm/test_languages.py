import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from parcelgraph.llm import languages
from parcelgraph.llm.registry import op8_language_id
from parcelgraph.llm.word_arrays import split_words, text_buffers
from tests.llm.conftest import DOCS

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = op8_language_id(spark, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages.identify(awkward, docs.select("text", "lang")).collect()
    assert len(got) == awkward.count()
    none = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert none == {None, 4, 5, 6, 12}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert languages.identify(awkward.limit(0), docs.select("text", "lang")).collect() == []


def test_mixtures_against_plain_inference(spark):
    """Expectation-maximisation word by word, as its definition says, for texts of one and of two languages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, model = languages.train(docs.select("text", "lang").filter("lang IS NOT NULL"))
    model = model.astype(float)

    def likelihood(word):
        padded = b" " + word + b" "
        at = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32 >> 16) & (languages.FEATURES - 1) for i in range(len(word))]
        log = sum(model[f] for f in at)
        return np.exp(np.maximum(log - log.max(), -60.0))

    def fit(rows, share, steps):
        for _ in range(steps):
            weight = [r * share / (r * share).sum() for r in rows]
            share = sum(weight) / len(rows)
        return share, sum(np.log((r * share).sum()) for r in rows)

    def plain(text):
        rows = [likelihood(w) for w in text.lower().encode().split()]
        share, fitted = fit(rows, np.full(len(names), 1 / len(names)), languages.STEPS)
        while (share > 0).sum() > 1:
            less = share.copy()
            less[np.where(share > 0, share, np.inf).argmin()] = 0
            less = less + 1e-6 * (less > 0)
            less, value = fit(rows, less / less.sum(), languages.MORE_STEPS)
            if fitted - value >= 0.5 * np.log(len(rows) + 1.0):
                break
            share, fitted = less, value
        return share

    some = [r["text"][:600] for r in docs.filter("n_chars > 700").orderBy("doc_id").limit(12).collect()]
    texts = some + [f"{a} {b}" for a, b in zip(some[:6], some[6:], strict=True)]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    got = languages.proportions(split_words(data, offsets, lower=True), model.astype(np.float32))
    for text, share in zip(texts, got, strict=True):
        if text.isascii():
            assert np.allclose(share, plain(text), atol=0.01)
    assert sum(t.isascii() for t in texts) >= 3


def test_nothing_learned(awkward):
    got = languages.identify(awkward, awkward.select("text", "lang").limit(0)).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_labels_without_words(spark):
    """A label whose texts have no words in a partition, beside one that has some."""
    rows = [(1, " ", "xx", None, None), (2, "\t\n", "xx", None, None), (3, "plain words here", "en", None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(1)
    got = {r["doc_id"]: r["lang_pred"] for r in languages.identify(docs, docs.select("text", "lang")).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}
    assert {r["lang_pred"] for r in languages.identify(docs, docs.filter("lang = 'xx'").select("text", "lang")).collect()} == {"und"}


def test_mixed_documents_have_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("n_chars > 800").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).orderBy("lang").collect()
    (a, x), (b, y) = ((r["lang"], r["text"][:700]) for r in some[:2])
    mixed = spark.createDataFrame([(1, f"{x}\n{y}", None, None, None), (2, x, None, None, None)], DOCS)
    got = {r["doc_id"]: dict(p.split(":") for p in r["languages"].split(",")) for r in languages.identify(mixed, docs.select("text", "lang")).collect()}
    assert set(got[1]) == {a, b} and set(got[2]) == {a}
