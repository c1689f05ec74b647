"""Exact top-k search by integer inner product: exhaustive term-at-a-time accumulation.

A component of a vector is a term, a vector the sparse row of its components that are not zero. Each task holds
some of the candidates as postings: for each term the places of the candidates that have it, with their weights.
It goes through the query rows in blocks; each of a query's terms adds its weighted postings to a dense array of
scores, one for each candidate held, and partition selection keeps the k best. Spark then merges the k of every
task. Candidates are read once and not shuffled; queries are written once to the shared folder, where tasks
read them; what is shuffled is k rows for each query and ``HELD_BYTES`` of candidates. Nothing passes the driver.
A lost task repeats its own candidates only.

Rows without an id cannot be named in a result and take no part, nor do rows whose vector is null or holds a null
or non-finite component. Missing last components of a shorter vector count as zero, so an empty vector
scores 0 with all. Rows that share the query's id are the query's own and no candidates of it. An id that several rows share
is asked once, with the least of its vectors in array order; as candidates each of the rows counts. Components beyond
``whole_vectors.MOST`` count as that. An empty table, and one without queries, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasift.llm.shared import Tables
from mediasift.llm.whole_vectors import matrix, portions, stored, usable, whole

#: Bytes of candidates that a task holds as postings, and queries whose scores it holds at once.
HELD_BYTES, QUERY_BLOCK = 32 << 20, 32
NONE = np.iinfo(np.int64).min


class Postings:
    """Candidates in the order of their ids, by term."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, weights = ids[order], weights[order]
        self.most = int(np.abs(weights).max(initial=0))
        # a term that all candidates have needs no places
        self.terms = []
        for column in weights.T:
            at = np.flatnonzero(column)
            self.terms.append((slice(None) if len(at) == len(column) else at, column[at]))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """A row of scores for each candidate, a column for each query."""
        most = self.most * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.int32 if most < 1 << 31 else np.int64
        out = np.zeros((len(self.ids), len(queries)), kind)
        for term in np.flatnonzero(queries.any(axis=0)).tolist():
            if term < len(self.terms):
                at, weight = self.terms[term]
                out[at] += weight.astype(kind)[:, None] * queries[:, term].astype(kind)
        return out

    def best(self, asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, candidate's place and score of the k best of each query; of equal scores the first places."""
        n = len(self.ids)
        found = np.ascontiguousarray(self.scores(queries).T).astype(np.int64)
        own = np.searchsorted(self.ids, asked, "left"), np.searchsorted(self.ids, asked, "right")
        masked = np.zeros(found.shape, bool)
        for row, (lo, hi) in enumerate(zip(*own, strict=True)):
            masked[row, lo:hi] = True
        least, most = int(found.min(initial=0)), int(found.max(initial=0))
        if max(-least, most) < (1 << 62) // (n + 1):
            # scores and places in one number, so that no two are equal
            rank = found * n + np.arange(n - 1, -1, -1)
            rank[masked] = NONE
            at = np.argpartition(rank, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), found.shape)
        else:
            at = np.stack([np.lexsort((np.arange(n), -np.maximum(row, -(1 << 62)), skip))[:k] for row, skip in zip(found, masked, strict=True)])
        row = np.repeat(np.arange(len(asked)), at.shape[1])
        at = at.ravel()
        keep = ~masked[row, at]
        return row[keep], at[keep], found[row, at][keep]


def search(rows: DataFrame, queries: Column, k: int = 20, *, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row where ``queries`` holds."""
    if k < 1:
        raise ValueError("k must be at least 1")
    tables = Tables(rows.sparkSession, "topk")
    taking = rows.where(F.col(f"`{id_col}`").isNotNull() & usable(F.col(f"`{vector}`")))
    value = whole(F.col(f"`{vector}`"), scale).alias("v")
    asked = taking.where(queries).select(F.col(f"`{id_col}`").cast("long").alias("id"), value).groupBy("id").agg(F.min("v").alias("v"))
    tables.save(asked, "queries")
    path = tables.path("queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in portions(batches, HELD_BYTES):
            postings = Postings(held.column("id").to_numpy(), matrix(held.column("v")))
            for block in stored(path, 64 * QUERY_BLOCK):
                ids, wanted = block.column(0).to_numpy(), matrix(block.column(1))
                for lo in range(0, len(ids), QUERY_BLOCK):
                    part = ids[lo : lo + QUERY_BLOCK]
                    row, at, score = postings.best(part, wanted[lo : lo + QUERY_BLOCK], k)
                    yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(postings.ids[at]), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = taking.select(F.col(f"`{id_col}`").cast("long").alias("id"), value).mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
