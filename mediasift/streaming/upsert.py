"""Incremental index updates from a stream of listings or files.

Each micro-batch writes its new and changed rows beside the stored index, which is rewritten once in
``MOST_CHANGES`` batches. A stream cannot see removals: run the sweep of a full refresh as a periodic batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasift.operators.index import diff, reuse
from mediasift.sources.store import INDEX, IndexStore


def upsert_batch(store: IndexStore, batch: DataFrame, encode: Callable[[DataFrame], DataFrame], scope: str = "/", number: tuple[str, int] | None = None, load: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Upserts the new and changed rows of a batch; a path that comes twice counts with its latest time.

    ``number`` is the stream and the batch in it; a batch that the index has already changes nothing."""
    last = W.partitionBy("filepath").orderBy(F.col("modified_at").desc(), F.col("size").desc())
    batch = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    manifest = store.manifest()
    if store.knows(number, manifest):
        return
    index = store.read(manifest)
    todo = batch.join(diff(batch, index, scope).where("state in ('new', 'changed')"), "filepath", "left_semi")
    if load:
        todo = store.hold(load(todo.select("filepath", "modified_at", "size")))
    known = reuse(todo, index)
    names = [c for c in INDEX.fieldNames() if c != "deleted"]
    fresh = known.where("donor is null").drop("vector", "donor")
    once = fresh.withColumn("__n", F.row_number().over(W.partitionBy("hash", "size").orderBy("filepath"))).where("__n = 1").drop("__n")
    vectors = encode(once).select("hash", "size", "vector")
    rows = known.where("donor is not null").select(*names).unionByName(fresh.join(vectors, ["hash", "size"]).select(*names))
    try:
        rows = store.hold(rows.withColumn("deleted", F.lit(None).cast("boolean")))
        if manifest is None or number or not rows.isEmpty():
            store.add(rows, based_on=manifest, batch=number)
    finally:
        store.release()


def stream_upsert(stream: DataFrame, store: IndexStore, checkpoint: str, encode: Callable[[DataFrame], DataFrame], *, scope: str = "/", available_now: bool = True, load: Callable[[DataFrame], DataFrame] | None = None):
    """Starts a query that keeps the stored index up to date with a stream (filepath, modified_at, size, hash, ...).

    The index notes the last batch of each checkpoint, so one that is run again after a failure changes nothing."""
    writer = stream.writeStream.foreachBatch(lambda df, n: upsert_batch(store, df, encode, scope, (checkpoint, n), load)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
