"""Scoring and ranking by exact dot products."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from mediasift.functions.paths import exclude_regex
from mediasift.functions.vectors import dot, doubles
from mediasift.sources.shared import shared_dir

#: Queries that a task scores at once, items whose scores it holds at once, and bytes of items it holds.
QUERY_BLOCK, ITEM_BLOCK, HELD_BYTES = 4096, 2048, 64 << 20


def weighted_vectors(terms: DataFrame) -> DataFrame:
    """qid and the sum of sign * multiplier * vector over its terms (qid, sign, multiplier, tvec); terms without a vector count for nothing.

    Each task adds up whole vectors of its own terms, ``QUERY_BLOCK`` queries at a time; the sums, a row for each query and task,
    are dealt by query and added in order, one vector in memory. Shorter vectors and null components count as zeros."""
    kind = terms.schema["qid"].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for qid, weight, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if qid not in sums and len(sums) >= QUERY_BLOCK:
                    yield rows(sums)
                    sums = {}
                sums[qid] = added(sums.get(qid), weight * pc.fill_null(vector.values, 0.0).to_numpy())
        if sums:
            yield rows(sums)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # the last query, whose rows may go on in the next batch
        for batch in batches:
            done: dict = {}
            for qid, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and qid not in held:
                    done |= held
                    held = {}
                held[qid] = added(held.get(qid), vector.values.to_numpy())
            if done:
                yield rows(done)
        if held:
            yield rows(held)

    def added(total: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        if total is None:
            return x
        if len(total) < len(x):
            total, x = x, total
        out = total.copy()
        out[: len(x)] += x
        return out

    def rows(sums: dict) -> pa.RecordBatch:
        vectors = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sums.values())]).astype(np.int32), np.concatenate(list(sums.values())))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), key_type), vectors], names=["qid", "qvec"])

    key_type = to_arrow_type(terms.schema["qid"].dataType)
    source = terms.select("qid", (F.col("sign") * F.col("multiplier")).cast("double").alias("w"), doubles(F.col("tvec")).alias("v")).where("v is not null and w is not null")
    schema = f"qid {kind}, qvec array<double>"
    return source.mapInArrow(own, schema).repartition("qid").sortWithinPartitions("qid").mapInArrow(together, schema)


def combine(vectors: list[list[float]], weights: list[float], width: int) -> list[float]:
    """The query vector of a few terms; no terms give the zero vector."""
    return reduce(lambda acc, vw: [a + vw[1] * float(b) for a, b in zip(acc, vw[0], strict=True)], zip(vectors, weights, strict=True), [0.0] * width)


def score(items: DataFrame, query: list[float] | Column, vector: str = "vector") -> DataFrame:
    """Items with their score, in double precision; zero vectors of unknown norm (null) have none."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return items.withColumn("score", dot(F.col(vector), q))


def not_excluded(rows: DataFrame, exclude_dirs: list[str] | None = None, query_files: list[str] | DataFrame | None = None, path: str = "filepath") -> DataFrame:
    """Drops paths that match the directory regex as paths, and paths of query files (a few, or a table of filepath)."""
    rows = rows.where(~F.col(path).rlike(exclude_regex(exclude_dirs)))
    if isinstance(query_files, DataFrame):
        return rows.join(query_files.select(F.col("filepath").alias(path)), path, "left_anti")
    return rows.where(~F.col(path).isin(*query_files)) if query_files else rows


def top_k(scored: DataFrame, k: int = 10, tie: str = "filepath") -> DataFrame:
    """The best k rows; not-a-number scores are left out and ties go by path."""
    if k < 1:
        raise ValueError("top must be at least 1")
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.col("score").desc(), F.col(tie)).limit(k)


def search(items: DataFrame, query: list[float], *, top: int = 10, exclude_dirs: list[str] | None = None, query_files: list[str] | DataFrame | None = None) -> DataFrame:
    """filepath and score of the best items; filters come before the limit."""
    return top_k(score(not_excluded(items, exclude_dirs, query_files), query), top).select("filepath", "score")


def format_results(rows: DataFrame) -> DataFrame:
    """One line per result: score to three decimals, tab, quoted path."""
    return rows.select(F.concat(F.format_string("%.3f", "score"), F.lit('\t"'), F.col("filepath"), F.lit('"')).alias("value"))


def write_vectors(rows: DataFrame, key: str, vector: str) -> str:
    """Writes keys and vectors (null ones left out) to the shared folder, where every task reads them in blocks."""
    path = f"{shared_dir(rows.sparkSession)}/vectors-{uuid.uuid4().hex}"
    rows.select(F.col(f"`{key}`").alias("key"), doubles(F.col(f"`{vector}`")).alias("v")).where("v is not null").write.parquet(path)
    return path


def read_vectors(path: str, block: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and vectors of written rows in blocks, one in memory at a time."""
    files, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    for batch in pads.dataset(folder, filesystem=files, format="parquet").to_batches(batch_size=block, batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield batch.column(0), matrix(batch.column(1))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def best_k(score: np.ndarray, tag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row with their tags, unordered; of equal scores the smallest tags."""
    if score.shape[1] <= k:
        return score, tag
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(score, at, 1).min(axis=1)
    # where more than k reach the k-th score, the tags decide
    for r in np.flatnonzero((score >= least[:, None]).sum(axis=1) > k).tolist():
        at[r] = np.lexsort((tag[r], -score[r]))[:k]
    return np.take_along_axis(score, at, 1), np.take_along_axis(tag, at, 1)


def knn(items: DataFrame, queries: DataFrame, k: int, *, item_key: str = "vec_id", vector: str = "vector", block: int = QUERY_BLOCK, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The best k items of every query: qid, item key, score, rk (ties by item key).

    Queries are written once to the shared folder. Items are read once: each task holds some of its items,
    goes through the queries in blocks, multiplies in numpy, and keeps the best k of each query, so what
    is shuffled is k rows for each query and ``held_bytes`` of items. Neither side passes the driver.
    """
    kinds = {"q": queries.schema["qid"].dataType.simpleString(), "i": items.schema[item_key].dataType.simpleString()}
    source = items.select(F.col(item_key).alias("item"), doubles(F.col(vector)).alias("v")).where("v is not null")
    asked = write_vectors(queries, "qid", "qvec")

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table, [("item", "ascending")]))  # places are in the order of keys
        keys, x = table.column(0).combine_chunks(), matrix(table.column(1).combine_chunks())
        for ids, q in read_vectors(asked, block):
            score, tag = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for lo in range(0, len(x), ITEM_BLOCK):
                got = q @ x[lo : lo + ITEM_BLOCK].T
                got[np.isnan(got)] = -np.inf
                tags = np.broadcast_to(np.arange(lo, lo + got.shape[1]), got.shape)
                score, tag = best_k(np.hstack([score, got]), np.hstack([tag, tags]), k)
            row = np.repeat(np.arange(len(ids)), score.shape[1])
            flat, place = score.ravel(), tag.ravel()
            ok = flat > -np.inf
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[ok])), keys.take(pa.array(place[ok])), pa.array(flat[ok])], names=["qid", "item", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size > held_bytes:
                    yield from solve(held)
                    held, size = [], 0
        if held:
            yield from solve(held)

    out = source.mapInArrow(run, f"qid {kinds['q']}, item {kinds['i']}, score double")
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "item")
    return out.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).withColumnRenamed("item", item_key)
