"""Batch encoders and the byte-pair tokeniser as Spark jobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift.functions.text import SPECIAL_TOKENS, WIDTH, clean, split_tokens

LENGTH = 77
LETTERS = re.compile(b"[a-z]+")
#: Bytes of text whose tokens are hashed at once; tokens that a task remembers, and the longest of them.
PIECE, KNOWN, KNOWN_BYTES = 1 << 20, 100_000, 64


def padded(encode: Callable[[np.ndarray], np.ndarray], size: int) -> Callable[[np.ndarray], np.ndarray]:
    """An encoder for batches of exactly ``size`` rows: the last chunk repeats its last row, results are cut."""

    def run(batch: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(batch), size):
            part = batch[lo : lo + size]
            short = size - len(part)
            full = np.concatenate([part, np.repeat(part[-1:], short, axis=0)]) if short else part
            out.append(encode(full)[: len(part)])
        return np.concatenate(out)

    return run


def encode_batches(rows: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], *, column: str = "pixels", out: str = "vector", batch: int = 8, shape: list[int] | None = None) -> DataFrame:
    """Rows with the L2-normalised output of an encoder, built once per worker, over an array column."""
    if batch < 1:
        raise ValueError("batch must be at least 1")

    def make():
        encode = make_encoder()

        def predict(x: np.ndarray) -> np.ndarray:
            y = np.asarray(encode(x), np.float32)
            with np.errstate(invalid="ignore", divide="ignore"):
                return y / np.linalg.norm(y, axis=-1, keepdims=True)

        return predict

    run = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)
    found = rows.withColumn(out, run(F.col(column)))
    return found.withColumn(out, F.when(~F.exists(out, F.isnan), F.col(out)))  # a zero vector has no direction


@lru_cache(1)
def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else one from 256 up."""
    # The ranges of bytes that stand for themselves.
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(token: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pieces of a token's letters after all merges, lowest rank first; the last letter ends the word.

    A queue has the places where a known pair begins, by rank; places are linked to those of their neighbours. All
    places of the lowest rank are merged, from left to right, before the pairs that arise count."""
    letters = [byte_letters()[b] for b in token.encode()]
    parts: list[str | None] = [*letters[:-1], letters[-1] + "</w>"]
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in ranks]
    heapify(queue)
    while queue:
        rank, places = queue[0][0], []
        while queue and queue[0][0] == rank:
            places.append(heappop(queue)[1])
        arisen = []
        for i in places:
            j = after[i]
            if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            arisen += [before[i], i]
        for i in arisen:
            if i >= 0 and parts[i] is not None and after[i] < n and (rank := ranks.get((parts[i], parts[after[i]]))) is not None:
                heappush(queue, (rank, i))
    return [p for p in parts if p is not None]


def tokenise(texts: DataFrame, merges: list[tuple[str, str]], *, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """key and ``tokens``: start, byte-pair ids of the cleaned text, end, zeros up to ``length``.

    Ids: the 256 byte letters, the same ending a word, the merges in order, start and end. Start and end that
    are written out in a text have their ids. A longer text keeps its first ids and the end. Each distinct token of a task is merged once; the list of
    merges, whose size the vocabulary fixes, is broadcast.
    """
    letters = sorted(byte_letters(), key=lambda c: (ord(c) > 255, ord(c)))
    pieces = [*letters, *[c + "</w>" for c in letters], *["".join(m) for m in merges]]
    start, end = len(pieces), len(pieces) + 1
    shared = texts.sparkSession.sparkContext.broadcast(({m: i for i, m in enumerate(merges)}, {p: i for i, p in enumerate(pieces)}))

    @F.pandas_udf("array<int>")
    def ids(tokens: pd.Series) -> pd.Series:
        ranks, codes = shared.value
        known: dict[str, list[int]] = {SPECIAL_TOKENS[0]: [start], SPECIAL_TOKENS[1]: [end]}

        def one(row) -> list[int]:
            out = [start]
            for t in row if row is not None else ():
                if len(out) >= length:
                    break
                if t not in known:
                    known[t] = [codes[p] for p in merge(t, ranks)]
                out += known[t]
            out = [*out[: length - 1], end]
            return out + [0] * (length - len(out))

        return tokens.map(one)

    return texts.select(key, ids(split_tokens(clean(F.col(text)))).alias("tokens"))


class Buckets(dict):
    """A mapping of tokens to twice their bucket, plus one where they count as negative, that hashes a token when asked; long tokens are not kept."""

    def __missing__(self, token: bytes) -> int:
        digest = hashlib.md5(token).hexdigest()
        place = 2 * (int(digest[:4], 16) % WIDTH) + int(digest[4], 16) % 2
        if len(token) <= KNOWN_BYTES:
            self[token] = place
        return place


def letter_runs(texts: pa.Array, most: int | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The runs of a-z of an Arrow array of strings that each end in a space, by pieces of about ``most`` bytes (``PIECE``): the row of each, and the runs.

    A piece ends after a byte that is no letter, so that no run is cut; texts of any length are cut up."""
    most = most or PIECE
    raw = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, stop = int(offsets[0]), int(offsets[-1])
    while lo < stop:
        hi = min(lo + most, stop)
        while hi < stop and 97 <= body[hi - 1] <= 122:
            rest = body[hi : min(hi + most, stop)]
            other = (rest < 97) | (rest > 122)
            hi += int(other.argmax()) + 1 if other.any() else len(rest)
        flag = (body[lo:hi] >= 97) & (body[lo:hi] <= 122)
        starts = np.flatnonzero(flag & ~np.concatenate([[False], flag[:-1]]))
        yield np.searchsorted(offsets, starts + lo, "right") - 1, LETTERS.findall(memoryview(body)[lo:hi])
        lo = hi


def hash_encode(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """key and the unit ``vector`` of signed bucket counts of the text's tokens, the runs of a-z in lower case.

    A map over rows: equal and null keys stay rows of their own. Texts whose counts are all zero have no
    vector and are left out. A task goes through its texts by pieces of ``PIECE`` bytes, whatever the rows and batches, and remembers
    the buckets of ``KNOWN`` tokens, so what it holds besides a batch does not grow with the table."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for batch in batches:
            v = np.zeros((batch.num_rows, WIDTH))
            for row, found in letter_runs(batch.column(1)):
                if len(known) > KNOWN:
                    known.clear()
                if not found:
                    continue
                place = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                first, rows = row[0], row[-1] - row[0] + 1
                v[first : first + rows] += np.bincount((row - first) * WIDTH + (place >> 1), 1 - 2 * (place & 1), rows * WIDTH).reshape(-1, WIDTH)
            norm = np.sqrt((v * v).sum(axis=1))
            kept = np.flatnonzero(norm)
            unit = v[kept] / norm[kept, None]
            vectors = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, WIDTH, dtype=np.int32), unit.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), vectors], names=["key", "vector"])

    # the space sets rows apart
    return texts.select(F.col(key).alias("key"), F.concat(F.lower(F.col(text)), F.lit(" ")).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>").toDF(key, "vector")
