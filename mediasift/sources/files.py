"""File systems by path: paths of the local one (which all executors see), and URIs of those that Arrow opens.

A URI is written as Hadoop writes paths: what follows the authority is the path as it is, without escapes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs

URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)")


class Place(NamedTuple):
    """A file system, and how its paths (which begin with ``base``) are written outside (beginning with ``head``)."""

    files: fs.FileSystem
    base: str
    head: str

    def inner(self, path: str) -> str:
        return self.base + path[len(self.head) :]

    def outer(self, path: str) -> str:
        return self.head + path[len(self.base) :]

    @property
    def local(self) -> bool:
        return isinstance(self.files, fs.LocalFileSystem)


@lru_cache(32)
def _remote(head: str) -> Place:
    files, base = fs.FileSystem.from_uri(head + "/")
    return Place(files, base.rstrip("/"), head)


def place_of(path: str) -> Place:
    """Where a path or URI is."""
    found = URI.match(path)
    if found and found[1] != "file":
        return _remote(found[0])
    head = "file://" if found else "file:" if path.startswith("file:") else ""
    return Place(fs.LocalFileSystem(), "", head)


def open_file(path: str) -> pa.NativeFile:
    place = place_of(path)
    return place.files.open_input_file(place.inner(path))
