"""WARC archives compressed with a dictionary.

An archive is a skippable frame that holds a Zstandard dictionary built from some
of its own records, then one frame per record.  Records are WARC/1.1; equal
payloads are stored once and revisited elsewhere.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.llm.files import open_folder, write_file
from parcelgraph.llm.shared import shared_folder, written

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
#: Bytes of records in an archive, before compression.
ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES = 32_768
#: Bytes of an archive's records from which its dictionary is built.
SAMPLE_BYTES = 1_000_000
#: When the pages were fetched, unless said otherwise: the test tables have no times.
DATE = "2024-01-01T00:00:00Z"
#: Repeated digests (150 bytes each) that are broadcast, and parts of one digest's rows beyond that.
BROADCAST_ROWS, SALTS = 200_000, 32

# Fixed values of the two formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_types(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type, refers_to and refers_to_url to ``page_id, url, html``.

    A null html is an empty payload.  Rows that share both payload and the least
    page_id are all responses.  Null ids sort last: a payload that only they have
    is a response each time.  Other columns are not read.

    Payloads stay where they are while the repeated digests are few enough to be
    broadcast; beyond that rows meet them by digest and a part of their id, so that
    a payload with a third of all rows is spread.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "url", "payload_digest")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = large.groupBy("payload_digest").agg(least.alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    if first.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(first), "payload_digest", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    of = lambda c, name: F.when(revisit, F.col(c)).alias(name)
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), of("first_id", "refers_to"), of("first_url", "refers_to_url"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _one_line(url: str | None) -> str | None:
    return None if url is None else " ".join(url.split())


def record(row: dict, date: str = DATE) -> bytes:
    """One WARC record."""
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else HTTP_HEAD + row["payload"]
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _record_id(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(row["url"]),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Payload-Length": row["payload_bytes"],
        "WARC-Refers-To": _record_id(row["refers_to"]) if revisit else None,
        "WARC-Refers-To-Target-URI": _one_line(row["refers_to_url"]) if revisit else None,
        "WARC-Refers-To-Date": date if revisit else None,
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread over the archive; their own bytes where there are too few to build one from."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [x[:SAMPLE_BYTES] for x in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> list[bytes]:
    """The frames of an archive."""
    raw = dictionary(records)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
    return [struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw, *map(compressor.compress, records)]


def _read_records(stream: io.BufferedReader) -> Iterator[tuple[dict, bytes]]:
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, v = line.decode().split(": ", 1)
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block


def read_archive(uri: str, name: str) -> Iterator[dict]:
    """The records of an archive, in order; a payload that doesn't have its digest is an error."""
    system, folder = open_folder(uri)
    with system.open_input_stream(f"{folder}/{name}", compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError(f"{name} has no dictionary frame")
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        with decompressor.stream_reader(f, read_across_frames=True) as plain:
            for head, block in _read_records(io.BufferedReader(plain, 1 << 20)):
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                payload = None
                if head["WARC-Type"] == "response":
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: {head['WARC-Record-ID']} is damaged")
                yield {
                    "page_id": _page_of(head["WARC-Record-ID"]),
                    "url": head.get("WARC-Target-URI"),
                    "payload": payload,
                    "payload_bytes": int(head["WARC-Payload-Length"]) if payload is None else len(payload),
                    "payload_digest": digest,
                    "record_type": head["WARC-Type"],
                    "refers_to": _page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
                }


def write_warc(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes archives, whose records have ``date``, to ``folder`` and returns the manifest: name, n_records, n_bytes.

    Names hold the task attempt, so what a lost task has written is never in the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, records, size, names = TaskContext.get(), [], 0, []

        def close() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(names):04d}.warc.zst"
            names.append(name)
            frames = archive(records)
            write_file(folder, name, frames)
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": [len(records)], "n_bytes": [sum(map(len, frames))]})

        for batch in batches:
            for i in range(batch.num_rows):
                records.append(record(batch.slice(i, 1).to_pylist()[0], date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return written(with_types(pages).mapInArrow(run, "name string, n_records long, n_bytes long"))


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the stored payload) of every record in the archives."""
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[dict] = []
                for row in read_archive(folder, name):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in columns.items()})
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in columns.items()})

    spread = manifest.select("name").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new shared folder and reads the archives back."""
    folder = shared_folder(pages.sparkSession)
    return read_warc(write_warc(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
