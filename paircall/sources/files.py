"""File listing and byte access through pyarrow, so that local, HDFS and object-store paths all work in tasks."""

from __future__ import annotations

from pyarrow import fs


# Schemes that Hadoop and pyarrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def plain_uri(path: str) -> str:
    """The path with the scheme that pyarrow knows."""
    scheme, _, rest = path.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}"


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(plain_uri(path))
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[len("file:"):]
    return fs.LocalFileSystem(), path


def list_files(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the visible files in the directory and those below it; URIs keep their scheme."""
    system, inner = open_filesystem(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(prefix + info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(
        (prefix + f.path, f.size)
        for f in found
        if f.type == fs.FileType.File
        and not any(part.startswith(("_", ".")) for part in f.path.removeprefix(info.path).strip("/").split("/"))
        and (not suffixes or f.base_name.endswith(suffixes))
    )


def exists(path: str) -> bool:
    system, inner = open_filesystem(path)
    return system.get_file_info(inner).type == fs.FileType.File


def open_input(path: str):
    """A seekable file."""
    system, inner = open_filesystem(path)
    return system.open_input_file(inner)


def read_all(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()
