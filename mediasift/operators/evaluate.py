"""Evaluation: zero-shot classes, accuracy, retrieval precision, samples, parity of encoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasift.functions.vectors import dot, doubles, l2_normalise
from mediasift.operators.search import HELD_BYTES, best_k, knn, matrix, read_vectors, write_vectors


def rank_classes(items: DataFrame, classes: DataFrame, k: int = 5, *, item_key: str = "vec_id", vector: str = "vector", keep: tuple[str, ...] = ()) -> DataFrame:
    """The best k classes of every item: item key, columns to keep, class_id, score, rk (ties by class_id).

    The ranking of an item needs no other item: each task goes through the written classes in blocks and keeps
    the best k for its own rows, so nothing is shuffled or joined, and items with equal keys are ranked alike.
    Items without a vector, and scores that are not a number, have no rows."""
    names = [item_key, *keep]
    source = items.select(*[F.col(c) for c in names], doubles(F.col(vector)).alias("v")).where("v is not null")
    listed = write_vectors(classes.orderBy("class_id"), "class_id", "cvec")  # places are in the order of ids
    fields = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in names)

    def held() -> list | None:
        """The classes, if they are small enough to be kept by a task."""
        blocks, size = [], 0
        for own, c in read_vectors(listed, 1024):
            blocks.append((own, c))
            size += c.nbytes
            if size > HELD_BYTES:
                return None
        return blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = held()
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                part = whole.slice(lo, 2048)
                x = matrix(part.column(len(names)))
                score, tag, ids, base = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64), [], 0
                for own, c in blocks if blocks is not None else read_vectors(listed, 1024):
                    got = x @ c.T
                    got[np.isnan(got)] = -np.inf
                    score, tag = best_k(np.hstack([score, got]), np.hstack([tag, np.broadcast_to(np.arange(base, base + len(own)), got.shape)]), k)
                    ids.append(own)
                    base += len(own)
                if not ids:
                    continue
                order = np.lexsort((tag, -score))
                score, tag = np.take_along_axis(score, order, 1), np.take_along_axis(tag, order, 1)
                row, rk = np.divmod(np.arange(score.size), score.shape[1])
                ok = score.ravel() > -np.inf
                at = pa.array(row[ok])
                found = pa.concat_arrays(ids).take(pa.array(tag.ravel()[ok]))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(names))], found, pa.array(score.ravel()[ok]), pa.array((rk[ok] + 1).astype(np.int32))], names=[*names, "class_id", "score", "rk"])

    return source.mapInArrow(run, f"{fields}, class_id {classes.schema['class_id'].dataType.simpleString()}, score double, rk int")


def accuracy(ranked: DataFrame, *, label: str = "label") -> DataFrame:
    """processed, top1, top5 of ranked classes that keep their item's label. Each ranked item counts, equal keys
    included; class ids are distinct."""
    hit = F.col("class_id") == F.col(label)
    share = lambda least: F.count_if(hit & (F.col("rk") <= least)) / F.count_if(F.col("rk") == 1)
    return ranked.agg(F.count_if(F.col("rk") == 1).alias("processed"), share(1).alias("top1"), share(5).alias("top5"))


def precision(items: DataFrame, queries: DataFrame, k: int = 100, *, item_key: str = "vec_id", label: str = "label") -> DataFrame:
    """Mean over queries (qid, qvec, qlabel) of the share of their returned items with the same label."""
    found = knn(items, queries, k, item_key=item_key)
    per = found.join(items.select(item_key, label), item_key).join(queries.select("qid", "qlabel"), "qid").groupBy("qid").agg(F.avg(F.when(F.col(label) == F.col("qlabel"), 1.0).otherwise(0.0)).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("p").alias("precision"))


def sample_per_class(rows: DataFrame, n: int, *, label: str, key: str, seed: int = 0) -> DataFrame:
    """n rows of each class, by the order of a seeded hash of the key: the same rows on every run."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return rows.withColumn("__h", order).withColumn("__n", F.row_number().over(W.partitionBy(label).orderBy("__h", key))).where(F.col("__n") <= n).drop("__h", "__n")


def parity(left: DataFrame, right: DataFrame, *, key: str, vector: str, min_cosine: float = 0.99999, max_diff: float = 1e-4) -> DataFrame:
    """Row count, least cosine, greatest difference and verdict of two encoders' normalised vectors."""
    a, b = left.select(key, l2_normalise(F.col(vector)).alias("a")), right.select(key, l2_normalise(F.col(vector)).alias("b"))
    diff: Column = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    out = a.join(b, key).select(dot(F.col("a"), F.col("b")).alias("c"), diff.alias("d")).agg(F.count(F.lit(1)).alias("compared"), F.min("c").alias("min_cosine"), F.max("d").alias("max_diff"))
    return out.withColumn("passed", (F.col("min_cosine") > min_cosine) & (F.col("max_diff") < max_diff))
