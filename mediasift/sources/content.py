"""Bytes of listed files. Tasks open exactly the files they are given, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mediasift.functions.media import HEAD, TAIL
from mediasift.sources.files import open_file


def content_of(path: str) -> bytes:
    with open_file(path) as f:
        return f.readall()


def fingerprint_of(path: str) -> str:
    """SHA-256 of the first mebibyte and, for more than a kibibyte, the last kibibyte; the rest is not read."""
    with open_file(path) as f:
        size, found = f.size(), hashlib.sha256(f.read(HEAD))
        if size > TAIL:
            f.seek(size - TAIL)
            found.update(f.read(TAIL))
    return found.hexdigest()


def with_file(rows: DataFrame, name: str, kind: str, get: Callable[[str], object], path: str = "filepath") -> DataFrame:
    """Rows with what ``get`` makes of each path as ``name``, and ``error`` (null: it could be read)."""
    place = rows.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few files at a time: contents are of any size
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                values, errors = [], []
                for p in part.column(place).to_pylist():
                    try:
                        values.append(get(p))
                        errors.append(None)
                    except OSError as error:
                        values.append(None)
                        errors.append(str(error))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, {"string": pa.string(), "binary": pa.binary()}[kind]), pa.array(errors, pa.string())], names=[*part.schema.names, name, "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` {kind}, error string")


def read_bytes(rows: DataFrame) -> DataFrame:
    """Rows of a listing with ``content`` and ``error``."""
    return with_file(rows, "content", "binary", content_of)


def fingerprints(rows: DataFrame) -> DataFrame:
    """Rows of a listing with ``hash`` and ``error``; of large files only head and tail are read."""
    return with_file(rows, "hash", "string", fingerprint_of)
