"""Byte ranges of files, opened inside tasks through the file systems that Arrow knows."""

from __future__ import annotations

import re

from pyarrow import fs

_LOCAL = re.compile(r"^file:/*(?=/)")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI; a path without scheme is a local one."""
    if _LOCAL.match(uri) or ":" not in uri.split("/", 1)[0]:
        return fs.LocalFileSystem(), _LOCAL.sub("", uri)
    return fs.FileSystem.from_uri(uri)


def named(uri: str, path: str) -> str:
    """A path of ``opened(uri)``'s file system, written as Spark's file sources write it."""
    if _LOCAL.match(uri) or ":" not in uri.split("/", 1)[0]:
        return "file:" + path
    scheme, _, rest = uri.partition("://")
    authority = rest.split("/", 1)[0]
    below = path.removeprefix(authority) if path.startswith(authority + "/") else path
    return f"{scheme}://{authority}/{below.lstrip('/')}"


def read_range(uri: str, start: int, length: int) -> bytes:
    """At most ``length`` bytes from ``start``; nothing else of the file is read."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        file.seek(start)
        return file.read(length)
