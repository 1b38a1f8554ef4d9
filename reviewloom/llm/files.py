"""Files written by tasks into the shared folder, committed by a manifest.

A task writes files under names of its own and returns a row for each.  The
rows are stored as a table; only files listed there count.  So files of failed
or repeated attempts are never read, and a lost executor costs a rerun of its
task only."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, data: list[bytes], suffix: str = "") -> str:
    """Write one new file; returns its name within ``folder``."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    with fs.open_output_stream(posixpath.join(path, name)) as out:
        for part in data:
            out.write(part)
    return name


def read_file(folder: str, name: str) -> bytes:
    fs, path = open_folder(folder)
    with fs.open_input_stream(posixpath.join(path, name)) as f:
        return f.read()
