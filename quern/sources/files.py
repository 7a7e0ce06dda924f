"""Ranged access to files by path or URI, on whatever node the code runs."""

from __future__ import annotations

from functools import lru_cache

from pyarrow import fs


@lru_cache(64)
def _system(scheme: str):
    return fs.FileSystem.from_uri(scheme)[0]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for absolute paths and URIs (file:, hdfs:, s3:, gs:)."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def read_range(path: str, begin: int, end: int) -> bytes:
    """Bytes [begin, end), fewer at the end of the file."""
    system, name = located(path)
    with system.open_input_file(name) as f:
        f.seek(begin)
        return f.read(max(0, min(end, f.size()) - begin))


def write_bytes(path: str, data: bytes) -> None:
    system, name = located(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as f:  # as it is, whatever the name's ending
        f.write(data)


def sizes(path: str) -> list[tuple[str, int]]:
    """The file, or a folder's files but hidden ones, with their sizes."""
    system, name = located(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((path.rstrip("/") + x.path[len(name.rstrip("/")) :], x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
