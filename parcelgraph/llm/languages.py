"""Language identification for texts in one or several languages.

A language's model is the probability of each byte trigram, words bounded by a
blank on either side.  A document is a mixture: each word comes from one language,
with the document's own proportions, which expectation-maximisation estimates
from the words' likelihoods.  The set of languages starts as all and loses the
one with the least share as long as that costs less log-likelihood than the
penalty of a parameter (half the logarithm of the number of words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelgraph.llm.word_arrays import Words, slices, split_words, text_buffers

#: Most labelled rows that the model is fitted on, taken by a hash of the row.
TRAIN_ROWS = 20_000
#: Trigrams are hashed to this many features.
FEATURES = 1 << 16
SMOOTHING = 0.5
#: Steps of expectation-maximisation: for all languages, and after each loss of one.
STEPS, MORE_STEPS = 12, 4
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _trigrams(words: Words) -> np.ndarray:
    """The feature at each byte of the texts; only bytes inside words count."""
    b = words.data.astype(np.uint32)
    before, after = np.empty_like(b), np.empty_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    before[words.starts], after[words.ends - 1] = 32, 32
    return (((before << 16 | b << 8 | after) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (FEATURES - 1)


def _in_words(words: Words) -> np.ndarray:
    mark = np.zeros(len(words.data) + 1, dtype=np.int8)
    mark[words.starts] += 1
    mark[words.ends] -= 1
    return np.cumsum(mark[:-1]) > 0


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in ``labelled`` (text, lang) in order, and the log-probability of each feature in each."""
    n = labelled.count()
    if n > TRAIN_ROWS:
        labelled = labelled.filter(F.shiftrightunsigned(F.xxhash64(F.lit("train"), "text"), 11) < int(TRAIN_ROWS / n * (1 << 53)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                words = split_words(data, offsets[a : b + 1], lower=True)
                if len(words.starts):
                    features, inside = _trigrams(words), _in_words(words)
                    doc = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))
                    for lang in set(langs[a:b]):
                        own = inside & (langs[doc] == lang)
                        sums[lang] = sums.get(lang, 0) + np.bincount(features[own], minlength=FEATURES)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "feature": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most FEATURES rows a language
    languages = sorted(counts["lang"].unique())
    table = np.full((FEATURES, len(languages)), SMOOTHING)
    table[counts["feature"], counts["lang"].map({x: i for i, x in enumerate(languages)}).astype(int)] += counts["n"]
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def proportions(words: Words, model: np.ndarray) -> np.ndarray:
    """Each text's proportions of the languages that its selected set keeps; zeros for a text without words."""
    n_docs, n_lang = len(words.offsets) - 1, model.shape[1]
    n_words = np.diff(words.offsets)
    out = np.zeros((n_docs, n_lang))
    full = n_words > 0
    if not full.any():
        return out
    per_byte = model[_trigrams(words)]
    per_byte[~_in_words(words)] = 0
    log_word = np.add.reduceat(per_byte, words.starts, axis=0)
    del per_byte
    log_word -= log_word.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(log_word, -60.0))

    def fit(share: np.ndarray, docs: np.ndarray, rows: np.ndarray, sizes: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        own = likely if len(docs) == full.sum() else likely[rows]
        edges = np.cumsum(sizes) - sizes
        for _ in range(steps):
            weight = own * np.repeat(share, sizes, axis=0)
            weight /= weight.sum(axis=1, keepdims=True)
            share = np.add.reduceat(weight, edges, axis=0) / sizes[:, None]
        total = np.log((own * np.repeat(share, sizes, axis=0)).sum(axis=1))
        return share.astype(np.float32), np.add.reduceat(total, edges)

    docs = np.flatnonzero(full)
    sizes = n_words[docs]
    word_doc = np.repeat(np.arange(n_docs), n_words)
    share, fitted = fit(np.full((len(docs), n_lang), 1 / n_lang, np.float32), docs, np.arange(len(likely)), sizes, STEPS)
    out[docs] = share
    for _ in range(n_lang - 1):
        more = (share > 0).sum(axis=1) > 1
        docs, sizes, share, fitted = docs[more], sizes[more], share[more], fitted[more]
        if not len(docs):
            break
        weakest = np.where(share > 0, share, np.inf).argmin(axis=1)
        less = share.copy()
        less[np.arange(len(docs)), weakest] = 0
        less = (less + 1e-6 * (less > 0)) / np.maximum((less + 1e-6 * (less > 0)).sum(axis=1, keepdims=True), 1e-12)
        rows = np.flatnonzero(np.isin(word_doc, docs)) if len(docs) < full.sum() else np.arange(len(likely))
        less, fitted_less = fit(less.astype(np.float32), docs, rows, sizes, MORE_STEPS)
        lost = fitted - fitted_less < 0.5 * np.log(sizes + 1.0)
        out[docs[lost]] = less[lost]
        docs, sizes, share, fitted = docs[lost], sizes[lost], less[lost], fitted_less[lost]
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    part = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    found, wide = count(_LETTER[part]) > 0, count(part >= 128) > 0
    for i in np.flatnonzero(~found & wide):
        found[i] = any(c.isalpha() for c in part[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """The column ``key``, lang_pred, score and the whole set as languages ("de:0.75,fr:0.25"): a row per row of ``docs``.

    ``und`` with score 0 for a null text, one without a letter, and all texts if
    nothing was learned.  ``docs`` has the text as a column, or in the struct ``key``.  Ties go to the first language in order.  The score is the
    predicted language's share.
    """
    languages, model = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column(key), "text")
            data, offsets = text_buffers(texts)
            for a, b in slices(offsets):
                known = has_letter(data, offsets[a : b + 1])
                share = proportions(split_words(data, offsets[a : b + 1], lower=True), model) if languages else np.zeros((b - a, 1))
                known &= share.sum(axis=1) > 0
                best = np.where(known, share.argmax(axis=1), len(languages))
                score = np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0)
                sets = [",".join(f"{languages[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) if k else "" for k, s in zip(known, share, strict=True)]
                columns = [batch.column(key).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score), pa.array(sets, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "lang_pred", "score", "languages"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())])
    return docs.select(key, *({"text"} & {*docs.columns})).mapInArrow(run, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def labelled_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and lang of documents outside the held-out fold."""
    return docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(remainder(F.col("doc_id"), 4) != 2).select("text", "lang")
