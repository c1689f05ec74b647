"""Listing a library level by level, one Spark step a level.

A step is a table of directories, dealt over tasks; each task goes through its directories and writes out the wanted names
below them. The directories among these are the next step. The driver sees counts only. Names are written as they are
read, 10,000 at a time, so a folder of any size needs little memory; the times and sizes of its files are then
looked up in as many tasks as its files need, cut by ranges of their paths. File systems that give times and sizes with the names
(all but the local one) need no look-up; Arrow gives a folder of these in one piece (some 300 bytes a name).

Hidden names (which begin with a dot) are skipped unless ``hidden`` is true; directories whose path matches the exclusion
are not entered; names must have a wanted extension. Links are followed; a directory that several paths lead to is
entered once, by the path on the highest level, of those by the smallest. A file or directory that cannot be read
has a null time and size and a reason. The root may be a path or a URI, and results are written alike.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.paths import IMAGE_EXTENSIONS, RAW_EXTENSIONS, exclude_regex, extension_regex
from mediasift.sources.files import Place, place_of
from mediasift.sources.shared import shared_dir

#: Directories and files of a task, rows of a batch, and levels (deeper ones are an error: some file system goes round).
DIRECTORIES_A_TASK, FILES_A_TASK, BATCH, MOST_LEVELS = 64, 20_000, 10_000, 1000
NAMES = "filepath string, name string, is_dir boolean, ident string, modified_at double, size long, reason string"
FIELDS = ["filepath", "name", "is_dir", "ident", "modified_at", "size", "reason"]


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


def identity(path: str) -> str:
    """The same for all local paths that lead to a directory."""
    try:
        info = os.stat(path)
    except OSError:
        return path  # whoever enters it reports it
    return f"{info.st_dev}:{info.st_ino}"


def entries(path: str, find: Callable[[str], Place], hidden: bool, exclude: re.Pattern, files: re.Pattern) -> Iterator[tuple]:
    """The wanted names right below a directory; local files without time and size."""
    try:
        place = find(path)
        if place.local:
            with os.scandir(place.inner(path)) as found:
                for e in found:
                    outer = place.outer(e.path)
                    if e.name.startswith(".") and not hidden:
                        continue
                    if e.is_dir():
                        if not exclude.match(outer):
                            yield outer, e.name, True, identity(e.path), None, None, None
                    elif files.match(e.name):
                        yield outer, e.name, False, None, None, None, None
            return
        for e in place.files.get_file_info(fs.FileSelector(place.inner(path), recursive=False)):
            outer, name = place.outer(e.path), e.base_name
            if name.startswith(".") and not hidden:
                continue
            if e.type == fs.FileType.Directory:
                if not exclude.match(outer):
                    yield outer, name, True, outer, None, None, None
            elif files.match(name):
                yield outer, name, False, None, e.mtime_ns / 1e9 if e.mtime_ns is not None else 0.0, e.size, None
    except OSError as error:
        yield path, path.rstrip("/").rsplit("/", 1)[-1], False, None, None, None, str(error) or type(error).__name__


def below(directories: DataFrame, find: Callable[[str], Place], hidden: bool, exclude: str, files: str) -> DataFrame:
    """One step: the wanted names below each directory (filepath)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, exclude_re, files_re = [], re.compile(exclude), re.compile(files)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in entries(path, find, hidden, exclude_re, files_re):
                    out.append(row)
                    if len(out) == BATCH:
                        yield rows_of(out)
                        out = []
        if out:
            yield rows_of(out)

    return directories.select("filepath").mapInArrow(run, NAMES)


def looked_up(names: DataFrame, tasks: int) -> DataFrame:
    """Times and sizes of local files, in tasks that each have a range of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    info = os.stat(place_of(path).inner(path))
                    out.append((path, name, False, None, float(info.st_mtime), int(info.st_size), None))
                except OSError as error:
                    out.append((path, name, False, None, None, None, str(error)))
            if out:
                yield rows_of(out)

    return names.select("filepath", "name").repartitionByRange(tasks, "filepath").mapInArrow(run, NAMES)


def written(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes tables below one folder of the shared one, and reads them back."""
    root = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"

    def hold(rows: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return hold


def list_library(
    spark: SparkSession, root: str, *, hidden: bool = False, exclude_dirs: list[str] | None = None, raw_support: bool = False,
    find: Callable[[str], Place] = place_of, hold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """filepath, name, modified_at (epoch seconds), size, reason of the wanted files below ``root``, as a written table.

    ``find`` gives the file system of a path; ``hold`` writes a step's table and reads it back."""
    hold = hold or written(spark)
    files = extension_regex(IMAGE_EXTENSIONS + (RAW_EXTENSIONS if raw_support else []))
    exclude, least = exclude_regex(exclude_dirs), spark.sparkContext.defaultParallelism
    root = root.rstrip("/") or "/"
    place = find(root)
    now, n = spark.createDataFrame([(root, identity(place.inner(root)) if place.local else root)], "filepath string, ident string"), 1
    found, seen, n_files = [], now.select("ident"), 0
    while n:
        if len(found) == MOST_LEVELS:
            raise OSError(f"{root} has more than {MOST_LEVELS} levels")
        # few directories have a task each
        tasks = min(n, max(least, -(-n // DIRECTORIES_A_TASK)))
        names = hold(below(now.repartition(tasks), find, hidden, exclude, files))
        found.append(names)
        n_files += names.where("not is_dir and modified_at is null and reason is null").count()
        once = names.where("is_dir").groupBy("ident").agg(F.min("filepath").alias("filepath"))
        now = hold(once.join(seen, "ident", "left_anti"))
        n = now.count()
        seen = seen.unionByName(now.select("ident"))
    names = found[0]
    for x in found[1:]:
        names = names.unionByName(x)
    ready = names.where("not is_dir and (modified_at is not null or reason is not null)")
    if n_files:
        ready = ready.unionByName(looked_up(names.where("not is_dir and modified_at is null and reason is null"), -(-n_files // FILES_A_TASK)))
    return hold(ready.select("filepath", "name", "modified_at", "size", "reason"))
