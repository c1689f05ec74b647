"""Vectors of whole numbers, and tables of them that tasks go through in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this count as it: inner products of up to 16,384 components then fit in a long.
MOST = 1 << 24
#: Sums of doubles below this are exact.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """False for null vectors and those with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, taken as a double and held within ``MOST``."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integers; shorter lists are filled with zeros, up to ``width`` at least."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    if len(flat) == width * len(lists):
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), flat.dtype)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def stored(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A written table in blocks, one in memory at a time."""
    files, folder = fs.FileSystem.from_uri(path)
    for batch in pads.dataset(folder, filesystem=files, format="parquet").to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield batch


def portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
