import hashlib
import struct

import pytest
import zstandard

from parcelgraph.llm import warc
from parcelgraph.llm.files import open_folder
from parcelgraph.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, payload string"
LONG = "<p>" + "ä line of text " * 20 + "</p>"
ROWS = [(5, "http://a/1\r\nX: y", LONG, "x"), (3, "http://a/2", LONG, None), (4, None, LONG, None), (6, "u", "short", None), (7, "u", "short", None), (8, "u", None, None), (9, "u", "", None), (None, "u", LONG, None), (10, "u", "a\r\n\r\nb" * 40, None), (11, "u", "y" * 300_000, None), (11, "u", "y" * 300_000, None)]


def brute():
    out = []
    for page_id, _, html, _ in ROWS:
        body = (html or "").encode()
        same = [r[0] for r in ROWS if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same) if len(body) >= 100 and same else page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = warc.archived(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute()


def test_payloads_and_dictionary_frame(spark):
    folder = shared_folder(spark)
    manifest = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), folder)
    stored = {r["payload_digest"]: bytes(r["payload"]) for r in warc.read_warc(manifest, folder, with_payload=True).collect() if r["record_type"] == "response"}
    assert {hashlib.sha256(p).hexdigest() for p in stored.values()} == set(stored)
    _, path = open_folder(folder)
    for r in manifest.collect():
        data = open(f"{path}/{r['name']}", "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and len(data) == r["n_bytes"]
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
        assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and first.unused_data is not None


def test_damage_is_noticed(spark, tmp_path):
    row = {"page_id": 1, "url": "u", "payload": b"x" * 200, "payload_bytes": 200, "payload_digest": "0" * 64, "record_type": "response", "refers_to": None}
    (tmp_path / "a.warc.zst").write_bytes(b"".join(warc.archive([warc.record(row)])))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.read_archive(str(tmp_path), "a.warc.zst"))


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
