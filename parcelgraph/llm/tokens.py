"""Token ids as flat binary files.

A part of the corpus is three files, little-endian: ``NAME.ids`` (unsigned ids,
16 bits wide where the vocabulary allows, else 32), ``NAME.offsets`` (n + 1
unsigned 64-bit positions in the part) and ``NAME.docs`` (n signed 64-bit ids of
documents; a part's first ``n_null`` have none).  Parts hold ascending ranges of
doc_id; a manifest has a row per part, and a prefix sum over it gives each part's
base.  Names hold the task attempt, so a repeated task never touches files that
the manifest names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.llm.files import open_folder, write_file
from parcelgraph.llm.shared import parts, shared_folder, text_bytes, written
from parcelgraph.llm.word_arrays import slices, split_words, text_buffers

END_ID = 1
#: Bytes of text in a part.
PART_BYTES = 24_000_000
#: Pieces that a worker remembers the ids of, over all its tasks; beyond, it forgets those met once.
MEMORY_WORDS = 600_000
#: Texts by which a tokenizer shows whether it may encode pieces: cases, marks, digits, contractions, other scripts, combining marks and white space of every kind.
PROBES = (
    "The quick brown Fox's den, isn't it? 12 3.45; A.B.C: end!", "  leading, trailing and\n\nbroken\tlines \r\n", "Ünïcödé ÉCOLE ﬁn Straße İ ΣΑΣ 日本語 emoji 😀.", "é é. x́. ,̧c a\x85b c\xa0d e\u2003f", "snake_case CamelCase http://h.x/a?b=c#d <b>e</b> (f) \"g\" 'h' --i",
)


class WordEncoder:
    """Encodes texts piece by piece and remembers what each piece gave.

    Pieces are words, cut between ASCII letters and the marks ``.,;:!?`` and, where
    no special token can be in the text, lower-cased in ASCII.  For a tokenizer
    that lower-cases, drops white space and never merges across it or between
    letters and marks, as the word BPE does, this equals encoding whole texts.  Other
    tokenizers, found out by PROBES, encode whole texts.

    Pieces are remembered by their bytes.  Within a slice of a megabyte they are
    told apart by 64-bit hashes and lengths.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.places: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.by_pieces = all(self._agrees(x) for x in PROBES)

    def _agrees(self, text: str) -> bool:
        """Whether a text's pieces give the ids of the whole."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self._by_pieces(raw, np.array([0, len(raw)]), 0)[0][:-1].tolist() == self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self, room: int) -> None:
        """Keeps pieces met in several slices, or none if they leave too little room."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) + room > MEMORY_WORDS:
            keep = keep[:0]
        names = list(self.places)  # in the order of their places
        lengths = self.lengths[keep]
        new_starts = np.cumsum(lengths) - lengths
        self.ids = self.ids[np.repeat(self.starts[keep] - new_starts, lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths, self.met = new_starts, lengths, np.zeros(len(keep), np.int32)
        self.places = {names[i]: at for at, i in enumerate(keep.tolist())}

    def _learn(self, words: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.met = np.concatenate([self.met, np.zeros(len(found), np.int32)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, each followed by ``end_id``, and how many each has."""
        if self.by_pieces:
            return self._by_pieces(data, offsets, end_id)
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable((*ids, end_id) for ids in found), np.uint32), np.array([len(ids) + 1 for ids in found], np.int64)

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw = data[offsets[0] : offsets[-1]].tobytes()
        words = split_words(data, offsets, lower=b"<|" not in raw, at_marks=True)
        key = words.hashes + (words.ends - words.starts).astype(np.uint64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        raw = words.data.tobytes()
        distinct = [raw[words.starts[i] : words.ends[i]] for i in first]
        if len(self.places) + len(distinct) > MEMORY_WORDS:
            self._forget(len(distinct))
        new = list(dict.fromkeys(w for w in distinct if w not in self.places))
        if new:
            self._learn(new)
        known = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
        self.met[known] += 1
        at = known[which]
        lengths = self.lengths[at]
        n_docs = len(offsets) - 1
        total = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(total[words.offsets]) + 1
        out = np.full(int(total[-1]) + n_docs, end_id, dtype=np.uint32)
        within = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
        doc_of_word = np.repeat(np.arange(n_docs), np.diff(words.offsets))
        out[np.arange(total[-1]) + np.repeat(doc_of_word, lengths)] = self.ids[np.repeat(self.starts[at], lengths) + within]
        return out, counts


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


_MANIFEST = "part int, name string, width int, n_docs long, n_null long, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` to ``folder`` and returns the manifest, a row per part that isn't empty.

    Null texts count as empty and give the end id alone; null ids come first; rows
    that share an id stand side by side in the order of their texts' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, counts, names, nulls = _encoder(tokenizer), [], [], [], 0
        for batch in batches:
            column = batch.column("doc_id")
            nulls += column.null_count
            names.append(column.fill_null(0).to_numpy())
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                some, n = encoder.encode(data, offsets[a : b + 1], end_id)
                ids.append(some.astype(f"<u{encoder.width}"))
                counts.append(n)
        if counts:
            context = TaskContext.get()
            part, n = context.partitionId(), np.concatenate(counts)
            name = f"part-{part:06d}-{context.taskAttemptId()}"
            write_file(folder, f"{name}.ids", [x.data for x in ids])
            write_file(folder, f"{name}.offsets", [np.concatenate([[0], np.cumsum(n)]).astype("<u8").tobytes()])
            write_file(folder, f"{name}.docs", [np.concatenate(names).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "width": pa.array([encoder.width], pa.int32()), "n_docs": [len(n)], "n_null": [nulls], "n_ids": [int(n.sum())]})

    n = parts(docs.sparkSession, text_bytes(docs), PART_BYTES)
    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(rows.mapInArrow(run, _MANIFEST))


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array; memory-mapped where the store is a local or mounted one."""
    system, path = open_folder(folder)
    at = f"{path}/{name}"
    if system.type_name == "local":
        return np.memmap(at, dtype=kind, mode="r") if os.path.getsize(at) else np.zeros(0, kind)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; ``with_ids`` adds the ids as unsigned 32-bit little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = _mapped(folder, f"{part['name']}.ids", f"<u{part['width']}")
                offsets = _mapped(folder, f"{part['name']}.offsets", "<u8").astype(np.int64)
                names = _mapped(folder, f"{part['name']}.docs", "<i8")
                for a in range(0, part["n_docs"], 2000):
                    b = min(a + 2000, part["n_docs"])
                    own = [ids[x:y].astype("<u4").tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)]
                    columns = {
                        "doc_id": pa.array(np.asarray(names[a:b]), pa.int64(), mask=np.arange(a, b) < part["n_null"]),
                        "start": pa.array(offsets[a:b] + part["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = based.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the corpus to a new shared folder and reads it back."""
    folder = shared_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id), folder)
