"""Writing packages: JSON documents, EAV files, triples, zip archives."""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.operators.rdf import RDFXML_HEAD, RDFXML_TAIL
from parcelgraph.plans.storage import grown, new_folder, tasks, written, written_path
from parcelgraph.plans.tables import Packages
from parcelgraph.sources.packages import METADATA_FILE


def _quoted(s: Column) -> Column:
    text = F.to_json(F.array(s))
    return text.substr(F.lit(2), F.length(text) - 2)


def _value(tag: Column) -> Column:
    """JSON of a top-level property from its typed columns, so that edits show."""
    link = lambda x: F.concat(F.lit('{"@id":'), _quoted(x), F.lit("}"))
    return (
        F.when(tag == "string", _quoted(F.col("s"))).when(tag == "id", link(F.element_at("ids", 1)))
        .when(tag == "ids", F.concat(F.lit("["), F.concat_ws(",", F.transform("ids", link)), F.lit("]"))).otherwise(F.col("json"))
    )


def documents(packages: Packages, indent: int | None = 2) -> DataFrame:
    """crate_id, text: every package as JSON-LD; entities in order, properties by name behind id and type."""
    top = packages.properties.filter((F.col("depth") == 0) & F.col("origin").isin("fixed", "dynamic"))
    member = F.struct("key", F.concat(_quoted(F.col("key")), F.lit(":"), _value(F.col("tag"))).alias("text"))
    members = top.groupBy("crate_id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["text"]), ",").alias("members"))
    types = F.when(F.col("types_is_array"), F.to_json("types")).otherwise(_quoted(F.element_at("types", 1)))
    entities = packages.entities.join(grown(members), ["crate_id", "pos"], "left")
    text = F.concat(F.lit('{"@id":'), _quoted(F.col("id")), F.lit(',"@type":'), types, F.when(F.col("members") != "", F.concat(F.lit(","), F.col("members"))).otherwise(""), F.lit("}"))
    graph = entities.groupBy("crate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))), lambda x: x["text"]), ",").alias("graph"))
    embedded = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda x: F.concat(_quoted(x["key"]), F.lit(":"), _quoted(x["value"]))), ","), F.lit("}"))
    items = packages.context_items.groupBy("crate_id", "pos").agg(F.when(F.max("kind") == "reference", _quoted(F.max("value"))).otherwise(embedded).alias("item"), F.max("kind").alias("kind"))
    context = items.groupBy("crate_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item", "kind"))).alias("all"))
    lone = (F.size("all") == 1) & (F.element_at("all", 1)["kind"] == "reference")
    context = context.select("crate_id", F.when(lone, F.element_at("all", 1)["item"]).otherwise(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["item"]), ","), F.lit("]"))).alias("context"))
    out = packages.crates.select("crate_id").join(grown(context), "crate_id", "left").join(grown(graph), "crate_id", "left")
    out = out.select("crate_id", F.concat(F.lit('{"@context":'), F.coalesce("context", F.lit("[]")), F.lit(',"@graph":['), F.coalesce("graph", F.lit("")), F.lit("]}")).alias("text"))
    if indent is None:
        return out

    def pretty(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[json.dumps(json.loads(t), indent=indent, ensure_ascii=False) + "\n" for t in b["text"]])

    return out.mapInPandas(pretty, "crate_id string, text string")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system, path.rstrip("/")


def write_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Writes each (crate_id, path, text) to ``folder/path`` and returns crate_id, path, n_bytes.  A file appears whole or not at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _store(folder)
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                home = os.path.dirname(f"{root}/{path}")
                system.create_dir(home, recursive=True)
                temporary = f"{home}/.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary) as out:
                    out.write(text.encode())
                system.move(temporary, f"{root}/{path}")
            yield pd.DataFrame({"crate_id": b["crate_id"], "path": b["path"], "n_bytes": [len(t.encode()) for t in b["text"]]})

    return docs.select("crate_id", "path", "text").mapInPandas(run, "crate_id string, path string, n_bytes long")


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.option("header", True).mode("overwrite").csv(path)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """N-Triples or N-Quads as text files."""
    lines.select("line").write.mode("overwrite").text(path)


def write_rdfxml(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes the elements of ``rdf.rdfxml`` as RDF/XML documents, one for each task, and returns path, blocks.  A file appears whole or not at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        name, n = uuid.uuid4().hex, 0
        with system.open_output_stream(f"{root}/.{name}") as out:
            out.write(RDFXML_HEAD.encode())
            for b in batches:
                for text in b["text"]:
                    out.write(text.encode())
                n += len(b)
            out.write(RDFXML_TAIL.encode())
        if n:
            system.move(f"{root}/.{name}", f"{root}/part-{name}.rdf")
            yield pd.DataFrame({"path": [f"{root}/part-{name}.rdf"], "blocks": [n]})
        else:
            system.delete_file(f"{root}/.{name}")

    return written(blocks.select("text").mapInPandas(run, "path string, blocks long"))


def archive_plan(files: DataFrame, flatten: bool = False) -> DataFrame:
    """crate_id, path, entry, external, relative (its path below the root) of (crate_id, root, path): the name of each file in its package's archive.

    A file inside the root keeps its relative path, or its base name with
    ``flatten``; one outside goes to ``external/``.  Two files with one entry name raise.
    """
    inside = F.startswith(F.col("path"), F.concat("root", F.lit("/")))
    base = F.element_at(F.split("path", "/"), -1)
    entry = F.when(inside & ~F.lit(flatten), F.substring(F.col("path"), F.length("root") + 2, F.length("path"))).when(inside, base).otherwise(F.concat(F.lit("external/"), base))
    relative = F.when(inside, F.substring(F.col("path"), F.length("root") + 2, F.length("path")))
    plan = files.select("crate_id", "path", entry.alias("entry"), (~inside).alias("external"), relative.alias("relative")).filter(F.col("entry") != METADATA_FILE)
    twice = plan.groupBy("crate_id", "entry").agg(F.count("*").alias("n"))
    checked = plan.join(twice, ["crate_id", "entry"])
    return checked.withColumn("entry", F.when(F.col("n") == 1, F.col("entry")).otherwise(F.raise_error(F.concat(F.lit("two files for the entry "), F.col("entry"))))).select("crate_id", "path", "entry", "external", "relative")


def listed_files(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """crate_id, root, path of every file below each ``root`` of (crate_id, root), hidden ones too, at every depth; tasks list the folders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for crate_id, root in zip(b["crate_id"], b["root"], strict=True):
                system, at = _store(root)
                found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
                yield pd.DataFrame({"crate_id": crate_id, "root": at, "path": pd.Series(found, dtype=object)})

    return roots.select("crate_id", "root").mapInPandas(run, "crate_id string, root string, path string")


def archived_ids(entities: DataFrame, plan: DataFrame) -> DataFrame:
    """crate_id, old, new: renames for entities whose id is the path of a planned file, so that it becomes the file's name in the archive; fragments keep theirs."""
    spellings = F.array_compact(F.array(F.col("path"), F.concat(F.lit("file://"), F.col("path")), F.col("relative"), F.concat(F.lit("./"), F.col("relative"))))
    named = plan.select("crate_id", F.explode(spellings).alias("old"), F.col("entry").alias("new"))
    own = entities.filter(~F.col("id").startswith("#")).select("crate_id", F.col("id").alias("old")).distinct()
    return own.join(named, ["crate_id", "old"]).filter("old != new").select("crate_id", "old", "new")


def parquet_bytes(frame: DataFrame) -> int:
    """How many bytes a frame takes as Parquet, written to a new place in the shared folder."""
    spark = frame.sparkSession
    at = written_path(frame)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return int(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength())


# Fixed values of the zip format: signatures, the version that knows 64-bit sizes, and flags (UTF-8 names, deflate).
_LOCAL, _CENTRAL, _END64, _LOCATOR, _END = b"PK\3\4", b"PK\1\2", b"PK\6\6", b"PK\6\7", b"PK\5\6"
_VERSION, _UTF8, _DEFLATED, _MIDNIGHT_1980, _IN_EXTRA = 45, 0x800, 8, 0x21, 0xFFFFFFFF
#: Bytes that are read at a time, and tasks that a thread of the cluster gets for compressing.
_COPIED, _TASKS_A_CORE = 1 << 20, 4


def _packed(members: DataFrame) -> DataFrame:
    """crate_id, entry, part, start, packed, size, crc of members (crate_id, entry, path or text): each compressed by some task into that task's file, wherever its package's others are."""
    spark = members.sparkSession
    folder = new_folder(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        part, at = f"{folder}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(_store(part)[1]) as out:
            for b in batches:
                rows = []
                for crate_id, entry, path, text in zip(b["crate_id"], b["entry"], b["path"], b["text"], strict=True):
                    z, crc, size, start = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, at
                    source, where = _store(path) if path is not None else (None, None)
                    with source.open_input_stream(where) if source is not None else io.BytesIO(text.encode()) as content:
                        while chunk := content.read(_COPIED):
                            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
                            at += out.write(z.compress(chunk))
                    at += out.write(z.flush())
                    rows.append((crate_id, entry, part, start, at - start, size, crc))
                yield pd.DataFrame(rows, columns=["crate_id", "entry", "part", "start", "packed", "size", "crc"])

    dealt = members.repartition(spark.sparkContext.defaultParallelism * _TASKS_A_CORE, "crate_id", "entry")
    return written(dealt.mapInPandas(run, "crate_id string, entry string, part string, start long, packed long, size long, crc long"))


def _assembled(out: BinaryIO, members: pd.DataFrame) -> None:
    """Writes an archive of compressed members: headers and members in turn, then the directory with their places."""
    names = [e.encode() for e in members["entry"]]
    heads = [30 + len(n) + 20 for n in names]
    sizes = (pd.Series(heads, dtype="int64") + members["packed"].reset_index(drop=True)).cumsum()
    places = [0, *map(int, sizes)]
    for name, row in zip(names, members.itertuples(), strict=True):
        head = struct.pack("<4s2B4HL2L2H", _LOCAL, _VERSION, 0, _UTF8, _DEFLATED, 0, _MIDNIGHT_1980, row.crc, _IN_EXTRA, _IN_EXTRA, len(name), 20)
        out.write(head + name + struct.pack("<HHQQ", 1, 16, row.size, row.packed))
        system, at = _store(row.part)
        with system.open_input_file(at) as content:
            content.seek(row.start)
            left = row.packed
            while left:
                chunk = content.read(min(left, _COPIED))
                out.write(chunk)
                left -= len(chunk)
    directory = 0
    for name, row, place in zip(names, members.itertuples(), places, strict=False):
        head = struct.pack("<4s4B4HL2L5H2L", _CENTRAL, _VERSION, 3, _VERSION, 0, _UTF8, _DEFLATED, 0, _MIDNIGHT_1980, row.crc, _IN_EXTRA, _IN_EXTRA, len(name), 28, 0, 0, 0, 0o600 << 16, _IN_EXTRA)
        directory += out.write(head + name + struct.pack("<HHQQQ", 1, 24, row.size, row.packed, place))
    n, behind = len(names), places[-1]
    out.write(struct.pack("<4sQ2H2L4Q", _END64, 44, _VERSION, _VERSION, 0, 0, n, n, directory, behind))
    out.write(struct.pack("<4sLQL", _LOCATOR, 0, behind + directory, 1) + struct.pack("<4s4H2LH", _END, 0, 0, 0xFFFF, 0xFFFF, _IN_EXTRA, _IN_EXTRA, 0))


def write_zips(docs: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Writes a zip per package to ``folder`` (any store), its document (crate_id, text) and its planned files, and returns crate_id, path, n_entries.

    Inputs are never changed.  Files are read and compressed by as many tasks as
    there are, however they spread over packages; putting a package's compressed
    members together, in the order of their names behind its document, is one
    task's copying.  The archive's name is the package's id, escaped so that
    different ids have different names; it appears whole or not at all.
    """
    null = F.lit(None).cast("string")
    members = docs.select("crate_id", F.lit(METADATA_FILE).alias("entry"), null.alias("path"), "text").unionByName(plan.select("crate_id", "entry", "path", null.alias("text")))

    def one(system: fs.FileSystem, root: str, crate_id: str, rows: pd.DataFrame) -> tuple[str, str, int]:
        name = f"{quote(crate_id, safe='')}.zip"
        temporary = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            _assembled(out, rows)
        system.move(temporary, f"{root}/{name}")
        return crate_id, f"{folder.rstrip('/')}/{name}", len(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come package by package; the last of a batch may go on in the next.
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        kept: list[pd.DataFrame] = []
        for b in batches:
            done, starts = [], [0, *(i for i in range(1, len(b)) if b["crate_id"].iat[i] != b["crate_id"].iat[i - 1]), len(b)]
            for at, end in zip(starts, starts[1:], strict=False):
                if kept and kept[0]["crate_id"].iat[0] != b["crate_id"].iat[at]:
                    done.append(one(system, root, kept[0]["crate_id"].iat[0], pd.concat(kept) if len(kept) > 1 else kept[0]))
                    kept = []
                kept.append(b.iloc[at:end])
            yield pd.DataFrame(done, columns=["crate_id", "path", "n_entries"])
        if kept:
            yield pd.DataFrame([one(system, root, kept[0]["crate_id"].iat[0], pd.concat(kept))], columns=["crate_id", "path", "n_entries"])

    ordered = _packed(members).repartition(tasks(docs.sparkSession), "crate_id").sortWithinPartitions("crate_id", F.col("entry") != METADATA_FILE, "entry")
    return ordered.mapInPandas(run, "crate_id string, path string, n_entries long")


def zip_bytes(document: str, files: dict[str, bytes]) -> bytes:
    """A package's archive in memory."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(METADATA_FILE, document)
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()
