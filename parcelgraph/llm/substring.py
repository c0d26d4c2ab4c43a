"""Removal of repeated passages.

Rabin-Karp hashes of every window of ``WINDOW`` words are dealt to buckets by
their value.  Each task first keeps only the earliest place of each hash it has
seen, so a passage in a third of all documents costs one row a task; a bucket's
task then finds the earliest place of all.  Every later place is removed, and
overlapping windows merge into maximal intervals.

Hashes and places travel as compressed arrays, some tens of thousands of windows
in a row of the shuffle.  Hashes have 64 bits: with w windows in all, the expected
number of wrongly equal pairs is w**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.llm.shared import parts, text_bytes
from parcelgraph.llm.word_arrays import slices, split_words, text_buffers, window_hashes

WINDOW = 20
#: Windows that a task gathers before it sends them on; each takes about 60 bytes of memory.
FLUSH = 2_000_000
#: Bytes of text whose windows or documents one bucket holds.
BUCKET_BYTES = 16_000_000


def _pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Places, compressed as differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(ids, prepend=0).astype("<i8").tobytes() + np.diff(starts, prepend=0).astype("<i4").tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.cumsum(np.frombuffer(raw, "<i4", n, 8 * n), dtype=np.int32)


def _later(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places in ascending order: which is the first of its hash, and which starts later than the first."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    first_of = order[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
    first = np.zeros(len(h), dtype=bool)
    first[order[head]] = True
    later = np.zeros(len(h), dtype=bool)
    later[order] = (ids[order] != ids[first_of]) | (starts[order] != starts[first_of])
    return first, later


def _in_order(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    if (np.diff(ids) < 0).any():
        order = np.lexsort((starts, ids))
        return hashes[order], ids[order], starts[order]
    return hashes, ids, starts


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(key[order[a]]), order[a:b]


def _gone_rows(ids: np.ndarray, starts: np.ndarray, groups: int, bucket: int) -> list[tuple]:
    return [(bucket, g, None, _pack(ids[at], starts[at])) for g, at in _groups(ids % groups)]


_ROW = pa.schema([("bucket", pa.int32()), ("doc_group", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _windows(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Rows of (bucket, hashes, places), a window's earliest place in this task, and of (doc_group, places), places known to be later ones."""

    def sent(found: list[tuple]) -> pa.RecordBatch | None:
        hashes, ids, starts = _in_order(*(np.concatenate(c) for c in zip(*found, strict=True)))
        first, later = _later(hashes, ids, starts)
        rows = _gone_rows(ids[later], starts[later], groups, -1) if later.any() else []
        hashes, ids, starts = hashes[first], ids[first], starts[first]
        rows += [(b, None, hashes[at].tobytes(), _pack(ids[at], starts[at])) for b, at in _groups(((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))]
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                hashes, at = window_hashes(split_words(data, offsets[a : b + 1], lower=False), WINDOW)
                if len(hashes):
                    counts = np.diff(at)
                    found.append((hashes, np.repeat(doc_ids[a:b], counts), (np.arange(len(hashes)) - np.repeat(at[:-1], counts)).astype(np.int32)))
                    n += len(hashes)
                if n >= FLUSH:
                    yield sent(found)
                    found, n = [], 0
        if found:
            yield sent(found)

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "bucket int, doc_group long, hashes binary, places binary")


def repeated_places(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """(doc_group, places): the starts of all windows whose words also start earlier."""

    def settle(rows: pa.Table) -> pa.Table:
        out = [r for r in zip(*(rows.column(c).to_pylist() for c in ("bucket", "doc_group", "hashes", "places")), strict=True) if r[2] is None]
        blobs = [(h.as_py(), p.as_py()) for h, p in zip(rows.column("hashes"), rows.column("places"), strict=True) if h.is_valid]
        if len(blobs) > 1:
            ids, starts = (np.concatenate(c) for c in zip(*(_unpack(p) for _, p in blobs), strict=True))
            hashes = np.frombuffer(b"".join(h for h, _ in blobs), np.uint64)
            hashes, ids, starts = _in_order(hashes, ids, starts)
            _, later = _later(hashes, ids, starts)
            if later.any():
                out += _gone_rows(ids[later], starts[later], groups, -1)
        return pa.Table.from_batches([_rows(out)] if out else [], _ROW).select(["doc_group", "places"])

    rows = _windows(docs, buckets, groups)
    salt = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("places"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    return rows.withColumn("bucket", salt).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, "doc_group long, places binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), removed (maximal intervals of word numbers, end excluded).

    A null text has no words and an empty kept text.  Rows that share a doc_id
    count as copies of one document: none is earlier than another, and a removal
    holds for all of them.  Rows with a null doc_id are neither earlier nor later
    than others and stay whole.
    """
    spark, size = docs.sparkSession, text_bytes(docs)
    buckets = parts(spark, size, BUCKET_BYTES)
    groups = next(n for n in range(buckets | 1, 1 << 62, 2) if all(n % d for d in range(3, int(n**0.5) + 1, 2)))  # a prime, so that strided ids spread too

    def cut(texts: pa.Table, gone: pa.Table) -> pa.Table:
        ids, starts = (np.concatenate(c) for c in zip(*(_unpack(p) for p in gone.column("places").to_pylist()), strict=True)) if gone.num_rows else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        out: list[tuple] = []
        for doc_id, text in zip(texts.column("doc_id").to_pylist(), texts.column("text"), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            a, b = (0, 0) if doc_id is None else np.searchsorted(ids, [doc_id, doc_id + 1])
            spans: list[dict] = []
            kept = words
            if b > a and len(words) >= WINDOW:
                own = starts[a:b]
                change = np.bincount(own, minlength=len(words) + 1)[: len(words) + 1] > 0
                change = change.astype(np.int64) - np.concatenate([np.zeros(WINDOW, np.int64), change[: len(words) + 1 - WINDOW].astype(np.int64)])
                removed = np.cumsum(change)[:-1] > 0
                kept = list(compress(words, (~removed).tolist()))
                turns = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("removed", pa.list_(span))])
    group = lambda key: F.pmod(key, F.lit(groups))
    texts = docs.select("doc_id", "text", group(F.coalesce(F.col("doc_id"), F.xxhash64("text"))).alias("doc_group"))
    gone = repeated_places(docs, buckets, groups)
    texts, gone = texts.repartition(groups, "doc_group"), gone.repartition(groups, "doc_group")
    return texts.groupBy("doc_group").cogroup(gone.groupBy("doc_group")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:int,end:int>>")
