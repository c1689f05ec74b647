"""Versioned index tables: Parquet files under one folder, and manifests that name them.

A version has base files, and up to ``MOST_CHANGES`` changes made since. A change holds rows that take the place of those
with their paths, and marks that only set or clear a row's ``deleted``; readers merge them in. ``path_key``, the path in
lower-case ASCII letters, is stored with each row; base files are ranges of it, and the manifest has the least and greatest
of every file, so a reader of one directory opens the files that overlap it, and filters on the stored column. Changes that are many,
or large against the base, are merged into the base files that they overlap; the others stay as they are.

Readers see the old or the new version and never a part. A version's manifest is put in place by a rename that fails
if the version exists, so of two writers that started from one version the second is refused. Batches of a stream are noted in the
manifest, so that a repeated one is recognised. Files that neither the current version nor the one before it names go
once they are ``GRACE_SECONDS`` old: younger ones may be another writer's. All files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift.functions.paths import ascii_lower, lower, scope_prefix

SCHEMA_VERSION = 4
#: Changes that a version may have besides its base, rows of these against the base's, and rows of a file that a merge writes.
MOST_CHANGES, MOST_SHARE, FILE_ROWS, GRACE_SECONDS = 16, 0.2, 1_000_000, 3600
INDEX = T.StructType([
    T.StructField("filepath", T.StringType(), False), T.StructField("modified_at", T.DoubleType(), False),
    T.StructField("size", T.LongType(), False), T.StructField("hash", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType()), False), T.StructField("deleted", T.BooleanType()),
])
STORED = T.StructType([*[T.StructField(f.name, f.dataType) for f in INDEX.fields], T.StructField("path_key", T.StringType()), T.StructField("mark", T.BooleanType())])


class Conflict(RuntimeError):
    """Another writer made the next version first; read again and repeat."""


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._held = spark, root.rstrip("/"), []
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _versions(self) -> list[int]:
        path = self._path("manifest-*.json")
        found = path.getFileSystem(self._conf).globStatus(path) or []
        return sorted(int(x.getPath().getName()[9:-5]) for x in found)

    def manifest(self, version: int | None = None) -> dict | None:
        """The current version's manifest, or that of another version that is still kept."""
        known = self._versions()
        version = known[-1] if version is None and known else version
        if version not in known:
            return None
        path = self._path(f"manifest-{version:08d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._versions())

    def has_rows(self) -> bool:
        return self.exists() and not self.read().isEmpty()

    def files(self, manifest: dict, scope: str | None = None, path: str | None = None) -> list[list[list]]:
        """Base files and those of each change ([name, least key, greatest key, rows]) that may have rows below ``scope``, or of ``path``."""
        low = lower(scope_prefix(scope)) if scope is not None else lower(path) if path is not None else ""
        # a key that begins with the prefix is not above it followed by the greatest character
        high = low + "\U0010ffff" if scope is not None else low if path is not None else "\U0010ffff" * 2
        return [[f for f in part if f[2] >= low and f[1] <= high] for part in (manifest["base"], *manifest["changes"])]

    def read(self, manifest: dict | None = None, scope: str | None = None, *, path: str | None = None, case_sensitive: bool = False) -> DataFrame:
        """The index, or its rows below the directory ``scope``, or of one path (both whatever the case, unless ``case_sensitive``)."""
        m = manifest or self.manifest()
        if m is None:
            return self.spark.createDataFrame([], INDEX)
        if m["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the index has schema version {m['schema_version']}; this code knows {SCHEMA_VERSION}")
        base, *changes = self.files(m, scope, path)

        def rows(files: list[list]) -> DataFrame:
            if not files:
                return self.spark.createDataFrame([], STORED)
            out = self.spark.read.schema(STORED).parquet(*[f"{self.root}/{f[0]}" for f in files])
            if scope is not None:
                out = out.where(F.col("path_key").startswith(lower(scope_prefix(scope))))
                return out.where(F.col("filepath").startswith(scope_prefix(scope))) if case_sensitive else out
            if path is not None:
                return out.where((F.col("path_key") == lower(path)) & (F.col("filepath") == path if case_sensitive else F.lit(True)))
            return out

        names, out = INDEX.fieldNames(), rows(base)
        late = None
        for n, files in enumerate(changes):
            if files:
                more = rows(files).withColumn("__n", F.lit(n))
                late = more if late is None else late.unionByName(more)
        if late is None:
            return out.select(*names)
        # of a path's changes the last row counts, and the last word on whether it is deleted
        last = late.groupBy("filepath").agg(
            F.max(F.when(~F.col("mark"), F.struct("__n", *names[1:-1]))).alias("row"), F.max(F.struct("__n", "deleted")).alias("said"),
        )
        kept = out.join(last.select("filepath", F.col("row").isNotNull().alias("replaced"), "said"), "filepath", "left").where(~F.coalesce("replaced", F.lit(False)))
        kept = kept.withColumn("deleted", F.when(F.col("said").isNotNull(), F.col("said.deleted")).otherwise(F.col("deleted")))
        fresh = last.where("row is not null").select("filepath", *[f"row.{c}" for c in names[1:-1]], "said.deleted")
        return kept.select(*names).unionByName(fresh)

    def hold(self, rows: DataFrame) -> DataFrame:
        """Rows written beside the index and read back, so that later steps do not repeat their work, until ``release``."""
        path = f"held-{uuid.uuid4().hex}"
        self._held.append(path)
        rows.write.parquet(f"{self.root}/{path}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")

    def release(self) -> None:
        """Removes what this object holds."""
        for name in self._held:
            self._path(name).getFileSystem(self._conf).delete(self._path(name), True)
        self._held = []

    def write(self, index: DataFrame, schema_version: int = SCHEMA_VERSION, based_on: dict | None = None) -> None:
        """A whole new base; ``based_on`` is the manifest that ``index`` was made from (default: the current one)."""
        old = based_on or self.manifest()
        self._commit(old, {"schema_version": schema_version, "base": self._save(index), "changes": []})

    def knows(self, batch: tuple[str, int] | None, manifest: dict | None) -> bool:
        """True if a batch (a stream and its number) is in the version already."""
        return batch is not None and (manifest or {}).get("batches", {}).get(batch[0], -1) >= batch[1]

    def add(self, rows: DataFrame | None = None, based_on: dict | None = None, *, marks: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Rows (columns of INDEX, distinct paths) in place of those with their paths, and marks (filepath, deleted) of
        others: only these are written. False if ``batch`` (a stream and a number) is in the index already."""
        old = based_on or self.manifest()
        if self.knows(batch, old):
            return False
        batches = {**(old or {}).get("batches", {}), **({batch[0]: batch[1]} if batch else {})}
        parts = [] if rows is None else [self._stored(rows)]
        if marks is not None and old is not None:
            names = [f for f in INDEX.fields if f.name not in ("filepath", "deleted")]
            parts.append(self._stored(marks.select("filepath", "deleted", *[F.lit(None).cast(f.dataType).alias(f.name) for f in names]), True))
        change = self._save_stored(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])) if parts else []
        if old is None:
            self._commit(None, {"schema_version": SCHEMA_VERSION, "base": change, "changes": [], "batches": batches})
            return True
        new = {"schema_version": old["schema_version"], "base": old["base"], "changes": [*old["changes"], change] if change else old["changes"], "batches": batches}
        n_base, n_changes = sum(f[3] for f in new["base"]), sum(f[3] for c in new["changes"] for f in c)
        if len(new["changes"]) > MOST_CHANGES or n_changes > MOST_SHARE * n_base:
            new = {**new, "base": self._merged(new), "changes": []}
        self._commit(old, new)
        return True

    def _stored(self, rows: DataFrame, mark: bool = False) -> DataFrame:
        return rows.select(*INDEX.fieldNames(), ascii_lower(F.col("filepath")).alias("path_key"), F.lit(mark).alias("mark"))

    def _save(self, rows: DataFrame) -> list[list]:
        return self._save_stored(self._stored(rows))

    def _save_stored(self, rows: DataFrame) -> list[list]:
        return self._files_of(rows.repartitionByRange("path_key", "filepath").sortWithinPartitions("path_key", "filepath"))

    def _files_of(self, rows: DataFrame) -> list[list]:
        """Writes rows as they are dealt, and returns each file with its bounds."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/{name}")
        found = self.spark.read.schema(STORED).parquet(f"{self.root}/{name}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("path_key").alias("lo"), F.max("path_key").alias("hi"), F.count(F.lit(1)).alias("n"))
        return sorted(([f"{name}/{r['file']}", r["lo"], r["hi"], r["n"]] for r in found.collect()), key=lambda f: f[1:3])  # a row a file

    def _merged(self, m: dict) -> list[list]:
        """Base files with all changes: those that a change overlaps are written anew, each into its own range."""
        base = sorted(m["base"], key=lambda f: f[1:3])
        if not base:
            return self._save(self.read(m))
        starts = np.array([f[1] for f in base], object)

        @F.pandas_udf("int")
        def range_of(keys: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(starts, keys.to_numpy(object), "right") - 1, 0).astype(np.int32))

        keys = self.spark.read.schema(STORED).parquet(*[f"{self.root}/{f[0]}" for c in m["changes"] for f in c]).select("path_key")
        hit = {r[0] for r in keys.select(range_of("path_key").alias("r")).distinct().collect()}  # a row a base file at most
        # files that share a key go together
        for i in range(1, len(base)):
            if base[i][1] <= base[i - 1][2] and hit & {i - 1, i}:
                hit |= {i - 1, i}
        for i in range(len(base) - 1, 0, -1):
            if base[i][1] <= base[i - 1][2] and i in hit:
                hit.add(i - 1)
        place = F.create_map(*[F.lit(x) for k, i in enumerate(sorted(hit)) for x in (i, k)])
        merged = self._stored(self.read({**m, "base": [base[i] for i in sorted(hit)]}))
        dealt = merged.withColumn("__at", place[range_of("path_key")]).repartitionById(len(hit), "__at").sortWithinPartitions("path_key", "filepath").drop("__at")
        return sorted([*[f for i, f in enumerate(base) if i not in hit], *self._files_of(dealt)], key=lambda f: f[1:3])

    def _commit(self, old: dict | None, new: dict) -> None:
        version = (old or {"version": 0})["version"] + 1
        new = {"version": version, "batches": (old or {}).get("batches", {}), **new}
        target, fresh = self._path(f"manifest-{version:08d}.json"), self._path(f"fresh-{uuid.uuid4().hex}.json")
        files = target.getFileSystem(self._conf)
        out = files.create(fresh, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        keep = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if version in self._versions() or version <= max(self._versions(), default=0):
                raise Conflict(f"version {version} exists")
            context.rename(files.makeQualified(fresh), files.makeQualified(target), keep)
        except Exception as error:
            files.delete(fresh, False)
            if isinstance(error, Conflict) or files.exists(target):
                raise Conflict(f"version {version} of {self.root} was made by another writer") from error
            raise
        self._expire(version, [new, old])

    def _expire(self, version: int, kept: list[dict | None]) -> None:
        names = {f[0] for m in kept if m for part in (m["base"], *m["changes"]) for f in part}
        folders, files = {x.split("/")[0] for x in names}, self._path("*").getFileSystem(self._conf)
        old = lambda status: time.time() - status.getModificationTime() / 1000 > GRACE_SECONDS
        for found in files.globStatus(self._path("*")) or []:
            name = found.getPath().getName()
            if name.startswith("manifest-"):
                if int(name[9:-5]) < version - 1:
                    files.delete(found.getPath(), True)
            elif name.startswith("rows-") and name in folders:
                for part in files.listStatus(found.getPath()):  # a merge leaves some files of a folder
                    own = part.getPath().getName()
                    if own.endswith(".parquet") and f"{name}/{own}" not in names and old(part):
                        files.delete(part.getPath(), False)
            elif name.startswith(("rows-", "held-", "skipped-", "fresh-")) and old(found):
                files.delete(found.getPath(), True)


def migrate(index: DataFrame, version: int, allow_reset: bool = True) -> DataFrame:
    """An index of an older schema version in the present schema.

    Before version 3 vectors are of another model and go, which ``allow_reset=False`` forbids when
    there are rows; version 3 lacks hashes; a version above the present one is refused."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"schema version {version} is newer than {SCHEMA_VERSION}")
    if version < 3:
        if not allow_reset and not index.isEmpty():
            raise ValueError("the stored vectors are of an older model and would be dropped")
        index = index.limit(0)
    for field in INDEX.fields:
        if field.name not in index.columns:
            index = index.withColumn(field.name, F.lit(None).cast(field.dataType))
    return index.select(*INDEX.fieldNames())
