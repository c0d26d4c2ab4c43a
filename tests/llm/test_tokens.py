import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from parcelgraph.llm import tokens
from parcelgraph.llm.files import open_folder
from parcelgraph.llm.shared import shared_folder
from parcelgraph.llm.word_arrays import text_buffers
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a<|endoftext|>b <|STARTOFTEXT|>. x's I'LL don't! 'Tis É É é. É.É İstanbul 1234 a.b.c ...'s ΣΑΣ.  x y", "", None, "a.́ b,̧c É.É", "x\x85y z\x1cq ﬁ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_equal_whole_texts_even_with_little_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 60)
    encoder = tokens.WordEncoder(PATH)
    texts = ODD + [r[1] for r in awkward_rows() if r[1] is None or len(r[1]) < 2000]
    for a in range(0, len(texts), 3):
        data, offsets = text_buffers(pa.array(texts[a : a + 3], pa.string()))
        ids, counts = encoder.encode(data, offsets, 1)
        expected = [ids_of(tokenizer, t) for t in texts[a : a + 3]]
        assert counts.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = tokens.WordEncoder(path), Tokenizer.from_file(path)
    assert tokens.WordEncoder(PATH).by_pieces and not encoder.by_pieces
    texts = [t for t in ODD if t]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, counts = encoder.encode(data, offsets, 1)
    assert ids.tolist() == [i for t in texts for i in ids_of(whole, t)] and counts.tolist() == [len(ids_of(whole, t)) for t in texts]


def test_files_round_trip(awkward, tokenizer, spark):
    folder = shared_folder(spark)
    manifest = tokens.write_tokens(awkward, PATH, folder)
    got = tokens.read_tokens(manifest, folder, with_ids=True).collect()
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((r[0], len(x := ids_of(tokenizer, r[1])), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for r in rows), key=repr)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == [r[0] for r in rows]
    at = 0
    for r in in_order:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    _, path = open_folder(folder)
    for part in manifest.collect():
        assert part["width"] == 2
        assert len(np.fromfile(f"{path}/{part['name']}.ids", "<u2")) == part["n_ids"]
        assert np.fromfile(f"{path}/{part['name']}.offsets", "<u8")[-1] == part["n_ids"]


def test_empty_table(empty):
    assert tokens.encoded(empty, PATH).collect() == []
