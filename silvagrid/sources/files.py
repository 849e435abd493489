"""Reading and writing single files from inside tasks, on any filesystem the cluster shares."""

from __future__ import annotations

from pyarrow import fs


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and inner path of a plain path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_range(path: str, start: int, length: int) -> bytes:
    system, inner = open_at(path)
    with system.open_input_file(inner) as handle:
        handle.seek(start)
        return handle.read(length)


def write_file(path: str, content: bytes) -> None:
    """Write a whole file. A retried task writes the same bytes again, so retries are harmless."""
    system, inner = open_at(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as handle:
        handle.write(content)


def read_text(path: str) -> str:
    system, inner = open_at(path)
    with system.open_input_stream(inner) as handle:
        return handle.read().decode()
