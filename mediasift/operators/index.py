"""Keeping the index table in step with a library: diff, reuse of vectors, upsert, sweep.

All steps are joins on ``filepath`` or ``(hash, size)``; nothing is looked up row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasift.functions.paths import in_scope
from mediasift.sources.store import INDEX


def diff(listing: DataFrame, index: DataFrame, scope: str, case_sensitive: bool = False) -> DataFrame:
    """filepath, state: new, changed, unchanged, gone or out_of_scope."""
    new = listing.select("filepath", F.col("modified_at").alias("l_time"), F.col("size").alias("l_size"), F.lit(True).alias("listed"))
    old = index.select("filepath", F.col("modified_at").alias("i_time"), F.col("size").alias("i_size"), F.lit(True).alias("indexed"))
    same = (F.col("l_time") == F.col("i_time")) & (F.col("l_size") == F.col("i_size"))
    state = (
        F.when(F.col("listed").isNull(), F.when(in_scope(F.col("filepath"), scope, case_sensitive), "gone").otherwise("out_of_scope"))
        .when(F.col("indexed").isNull(), "new").when(same, "unchanged").otherwise("changed")
    )
    return new.join(old, "filepath", "full_outer").select("filepath", state.alias("state"))


def scan(index: DataFrame, prefix: str, case_sensitive: bool = False) -> DataFrame:
    """Live rows under a directory: filepath and vector."""
    return index.where(F.col("deleted").isNull() & in_scope(F.col("filepath"), prefix, case_sensitive)).select("filepath", "vector")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Index rows, deleted ones included, of a table of paths; a semi-join in place of point lookups."""
    return index.join(keys.select("filepath").distinct(), "filepath", "left_semi")


def sweep(index: DataFrame, alive: DataFrame, scope: str, case_sensitive: bool = False) -> DataFrame:
    """Marks rows in scope that are not among the ``alive`` paths as deleted."""
    live = alive.select("filepath", F.lit(True).alias("__alive")).distinct()
    gone = F.col("__alive").isNull() & in_scope(F.col("filepath"), scope, case_sensitive)
    return index.join(live, "filepath", "left").withColumn("deleted", F.when(gone, F.lit(True)).otherwise(F.col("deleted"))).select(*INDEX.fieldNames())


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with ``rows`` inserted or, on equal paths, replaced; replaced rows are live again."""
    fresh = rows.select(*[c for c in INDEX.fieldNames() if c != "deleted"]).withColumn("deleted", F.lit(None).cast("boolean"))
    return index.select(*INDEX.fieldNames()).join(fresh.select("filepath"), "filepath", "left_anti").unionByName(fresh)


def donors(index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One live row for each (hash, size), of those that are ``wanted``: the one with the smallest path."""
    live = index.where(F.col("deleted").isNull() & F.col("hash").isNotNull())
    if wanted is not None:
        live = live.join(wanted.select("hash", "size").distinct(), ["hash", "size"], "left_semi")
    return live.groupBy("hash", "size").agg(F.min(F.struct("filepath", "vector")).alias("d")).select("hash", "size", F.col("d.filepath").alias("donor"), F.col("d.vector").alias("vector"))


def reuse(loaded: DataFrame, index: DataFrame) -> DataFrame:
    """Loaded rows (filepath, modified_at, size, hash, ...) with the donor and vector of equal content, or nulls."""
    return loaded.join(donors(index), ["hash", "size"], "left")


def duplicates(files: DataFrame) -> DataFrame:
    """Groups of files with equal (hash, size)."""
    return files.where("hash is not null").groupBy("hash", "size").agg(F.count(F.lit(1)).alias("files"), F.min("filepath").alias("first"), F.max("filepath").alias("last")).where("files > 1")


def refresh(
    listing: DataFrame, index: DataFrame, scope: str, load: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame], *,
    restore_deleted: bool = True, case_sensitive: bool = False, hold: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """The next index: diff, load, reuse or encode, upsert, sweep.

    ``load`` maps rows (filepath, modified_at, size) to rows with a hash, leaving out what fails;
    ``encode`` maps rows to rows with a vector, each content once. Rows that fail are swept.
    ``restore_deleted=False`` leaves a deleted row deleted when its unchanged file is back.
    ``hold`` may write loaded rows and read them back, so that files are read once.

    One full outer join by path serves the diff and the result; loaded rows join it once.
    """
    names = INDEX.fieldNames()
    disk = listing.select("filepath", F.struct(*[c for c in listing.columns if c != "filepath"]).alias("disk"))
    kept = index.select("filepath", F.struct(*names[1:]).alias("kept"))
    same = (F.col("disk.modified_at") == F.col("kept.modified_at")) & (F.col("disk.size") == F.col("kept.size"))
    base = disk.join(kept, "filepath", "full_outer").withColumn("same", F.coalesce(same, F.lit(False)))
    todo = base.where("disk is not null and not same").select("filepath", "disk.*")
    known = hold(reuse(load(todo), index))
    fresh = known.where("donor is null").drop("vector", "donor")
    once = fresh.withColumn("__n", F.row_number().over(W.partitionBy("hash", "size").orderBy("filepath"))).where("__n = 1").drop("__n")
    vectors = encode(once).select("hash", "size", F.col("vector").alias("encoded")).where("encoded is not null")
    rows = known.join(vectors, ["hash", "size"], "left").withColumn("vector", F.coalesce("vector", "encoded")).where("vector is not null")
    rows = rows.select("filepath", F.struct(*names[1:-1], F.lit(None).cast("boolean").alias("deleted")).alias("row"))
    inside = in_scope(F.col("filepath"), scope, case_sensitive)
    back = F.lit(None).cast("boolean") if restore_deleted else F.col("kept.deleted")
    deleted = F.when(F.col("same"), back).when(inside, F.lit(True)).otherwise(F.col("kept.deleted"))
    old = F.when(F.col("kept").isNotNull(), F.struct(*[F.col(f"kept.{c}").alias(c) for c in names[1:-1]], deleted.alias("deleted")))
    out = base.join(rows, "filepath", "left").select("filepath", F.coalesce("row", old).alias("x")).where("x is not null")
    return out.select("filepath", "x.*")


def delta(
    listing: DataFrame, index: DataFrame, scope: str, load: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame], *, within: DataFrame | None = None,
    restore_deleted: bool = True, case_sensitive: bool = False, hold: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame | None, DataFrame | None, dict[str, int]]:
    """What ``refresh`` changes: rows to put in place, marks (filepath, deleted), and counts; None where there is nothing.

    ``within`` is the part of the index in scope, if it can be read alone. Times and sizes decide by one join
    without vectors; only vectors of contents that are loaded are read. The counts are observed in that join:
    visited, unchanged, new, changed, gone (live rows), restored, written, marked."""
    names = INDEX.fieldNames()
    disk = listing.select("filepath", F.col("modified_at").alias("l_time"), F.col("size").alias("l_size"), F.lit(True).alias("listed"))
    kept = (index if within is None else within).select("filepath", F.col("modified_at").alias("i_time"), F.col("size").alias("i_size"), F.col("deleted").isNotNull().alias("was_deleted"))
    same = (F.col("l_time") == F.col("i_time")) & (F.col("l_size") == F.col("i_size"))
    state = F.when(F.col("listed").isNull(), "gone").when(F.col("was_deleted").isNull(), "new").when(same, "unchanged").otherwise("changed")
    both = disk.join(kept, "filepath", "full_outer").withColumn("state", state)
    both = both.where(F.col("listed").isNotNull() | in_scope(F.col("filepath"), scope, case_sensitive)).select("filepath", "l_time", "l_size", "state", F.coalesce("was_deleted", F.lit(False)).alias("was_deleted"))
    seen = Observation()
    back = F.lit(restore_deleted) & (F.col("state") == "unchanged") & F.col("was_deleted")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))
    both = both.observe(
        seen, count(F.col("state") != "gone").alias("visited"), count((F.col("state") == "gone") & ~F.col("was_deleted")).alias("gone"), count(back).alias("restored"),
        *[count(F.col("state") == x).alias(x) for x in ("unchanged", "new", "changed")],
    )
    observed, both = both, hold(both)
    if both is observed:  # ``hold`` has not run it
        both.write.format("noop").mode("overwrite").save()
    counts = {**seen.get, "written": 0, "marked": 0}
    rows = None
    gone = both.where("state = 'gone' and not was_deleted").select("filepath", F.lit(True).alias("deleted"))
    marks = gone.unionByName(both.where(back).select("filepath", F.lit(None).cast("boolean").alias("deleted")))
    if counts["new"] or counts["changed"]:
        todo = both.where("state in ('new', 'changed')").select("filepath", F.col("l_time").alias("modified_at"), F.col("l_size").alias("size"))
        loaded = hold(load(todo))
        known = hold(loaded.join(donors(index, loaded), ["hash", "size"], "left"))
        fresh = known.where("donor is null").drop("vector", "donor")
        once = fresh.withColumn("__n", F.row_number().over(W.partitionBy("hash", "size").orderBy("filepath"))).where("__n = 1").drop("__n")
        vectors = encode(once).select("hash", "size", F.col("vector").alias("encoded")).where("encoded is not null")
        rows = known.join(vectors, ["hash", "size"], "left").withColumn("vector", F.coalesce("vector", "encoded")).where("vector is not null")
        rows = hold(rows.withColumn("deleted", F.lit(None).cast("boolean")).select(*names))
        counts["written"] = rows.count()
        failed = both.where("state = 'changed' and not was_deleted").join(rows.select("filepath"), "filepath", "left_anti")
        marks = marks.unionByName(failed.where(in_scope(F.col("filepath"), scope, case_sensitive)).select("filepath", F.lit(True).alias("deleted")))
    if counts["gone"] or counts["restored"] or counts["changed"]:
        marks = hold(marks)
        counts["marked"] = marks.count()
    return rows if counts["written"] else None, marks if counts["marked"] else None, counts
