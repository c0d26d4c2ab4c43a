import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from parcelgraph.llm import quality
from parcelgraph.llm.registry import op4_quality_gam
from parcelgraph.llm.word_arrays import text_buffers

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = op4_quality_gam(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.95 * len(held)
    good, bad = ([r["score"] for r in held if label[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.97


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(100 + i, i % 2, None) for i in range(30)] + [(1, None, 1), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(awkward.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.score(awkward, labels.limit(0)).collect()} == {0.5}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert {7, 2} in map(set, model.pairs)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["A b c.\nA b c.\n", "", None, "x | y | z!! 123", "ä" * 50]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    together = quality.features(data, offsets)
    for i, t in enumerate(texts):
        data, offsets = text_buffers(pa.array([t], pa.string()))
        assert np.allclose(quality.features(data, offsets)[0], together[i])


def test_features_and_scores_against_plain_python():
    text = "Ein Wort, zwei WORTE!\nEin Wort, zwei WORTE!\nx1 | /path 22 ä..?"
    raw, words, lines = text.encode(), text.encode().split(), text.encode().split(b"\n")
    count = lambda chars: sum(raw.count(c.encode()) for c in chars) / len(raw)
    expected = {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_length": np.mean([len(w) for w in words]), "word_length_spread": np.std([len(w) for w in words]), "log_longest_word": np.log1p(max(map(len, words))),
        "short_words": np.mean([len(w) <= 3 for w in words]), "lines_per_word": len(lines) / len(words), "distinct_words": len(set(words)) / len(words), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "upper": sum(65 <= b < 91 for b in raw) / len(raw), "digits": count("0123456789"), "punctuation": count(".,;:!?'\"()-"), "pipes": count("|"), "exclamations": count("!"), "ends": count(".?!"), "commas": count(","), "slashes": count("/"), "non_ascii": sum(b > 127 for b in raw) / len(raw),
    }
    data, offsets = text_buffers(pa.array([text], pa.string()))
    got = dict(zip(quality.FEATURES, quality.features(data, offsets)[0], strict=True))
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(500, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float))
    for row, score in zip(x[:20], model.scores(x[:20]), strict=True):
        bins = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.intercept + sum(model.tables[j][b] for j, b in enumerate(bins))
        total += sum(t[bins[i] * quality.PAIR_BINS // quality.BINS][bins[j] * quality.PAIR_BINS // quality.BINS] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(empty, none).collect() == []
    assert {r["score"] for r in quality.score(awkward, none).collect()} == {0.5}
