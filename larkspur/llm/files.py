"""Reading and writing files of an own format in a shared folder, by URI, from within tasks.

A file is written under a name of its own and then moved to its final name, so a task that runs twice,
or is lost half-way, leaves one whole file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _plain(uri: str) -> str:
    """file:/x and file:///x are one folder; pyarrow knows the second form only."""
    return "file:///" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri


def make_folder(uri: str) -> None:
    f, path = _open(_plain(uri))
    f.create_dir(path, recursive=True)


def write_file(uri: str, content: bytes) -> None:
    f, path = _open(_plain(uri))
    own = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(own) as out:
        out.write(content)
    f.move(own, path)


def read_file(uri: str, start: int = 0, length: int | None = None) -> bytes:
    f, path = _open(_plain(uri))
    with f.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)
