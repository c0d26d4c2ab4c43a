"""Files that tasks write to and read from a shared folder, given as a URI or a path."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system, path.rstrip("/")


def write_file(uri: str, name: str, parts: list) -> None:
    """Writes buffers as one file.  It appears whole or not at all, since it is renamed when it is complete."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    system.move(temporary, f"{folder}/{name}")
