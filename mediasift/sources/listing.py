"""A Spark data source that lists a media library.

``spark.read.format("library").option("root", dir).load()`` gives filepath, name, modified_at (epoch
seconds as the file system has them) and size. Unlike Spark's file sources it keeps names that begin
with an underscore. Hidden names are skipped unless ``hidden`` is true, directories whose path
matches ``excludeDirs`` (a regex) are pruned, names must match ``files`` (a regex). Links are followed,
each directory once. The driver looks into directories, level by level, until there are ``PARTITIONS`` of them; each is
then a partition with all below it. The root must be reachable from all executors. A file or directory that
cannot be read has a null time and size and a reason. ``walk.list_library`` lists libraries of any size and
on any file system, in steps of Spark; this source suits those that a few hundred tasks can go through alone.

``spark.readStream.format("library")`` takes the same options and gives new and changed files.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mediasift.functions.paths import EXCLUDED_DIRS, IMAGE_EXTENSIONS, exclude_regex, extension_regex


#: Directories that the driver deals out, at least, if there are so many.
PARTITIONS = 512


class SubTree(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.hidden = str(options.get("hidden", "false")).lower() == "true"
        self.exclude = options.get("excludedirs") or exclude_regex(EXCLUDED_DIRS)
        self.files = options.get("files") or extension_regex(IMAGE_EXTENSIONS)

    def _wanted_dir(self, entry: os.DirEntry) -> bool:
        return entry.is_dir() and (self.hidden or not entry.name.startswith(".")) and not re.match(self.exclude, entry.path)

    def partitions(self) -> list[SubTree]:
        # directories whose own files are read alone, and those that are read with all below
        single, whole, seen = [], [self.root], set()
        while whole and len(single) + len(whole) < PARTITIONS:
            below = []
            for here in whole:
                single.append(SubTree(here, False))
                try:
                    info = os.stat(here)
                    if (info.st_dev, info.st_ino) not in seen:
                        seen.add((info.st_dev, info.st_ino))
                        below += sorted(e.path for e in os.scandir(here) if self._wanted_dir(e))
                except OSError:
                    pass  # the task that reads it reports it
            whole = [p for p in below if self._id(p) not in seen]
        return [*single, *[SubTree(p, True) for p in whole]]

    @staticmethod
    def _id(path: str) -> tuple[int, int] | None:
        try:
            info = os.stat(path)
        except OSError:
            return None
        return info.st_dev, info.st_ino

    def read(self, partition: SubTree) -> Iterator[tuple]:
        todo, seen = [partition.path], set()
        while todo:
            here = todo.pop()
            try:
                info = os.stat(here)
                if (info.st_dev, info.st_ino) in seen:
                    continue
                seen.add((info.st_dev, info.st_ino))
                entries = list(os.scandir(here))
            except OSError as error:
                yield here, os.path.basename(here), None, None, str(error)
                continue
            for e in entries:
                if e.is_dir():
                    if partition.recursive and self._wanted_dir(e):
                        todo.append(e.path)
                elif (self.hidden or not e.name.startswith(".")) and re.match(self.files, e.name):
                    try:
                        meta = e.stat()
                        yield e.path, e.name, float(meta.st_mtime), int(meta.st_size), None
                    except OSError as error:
                        yield e.path, e.name, None, None, str(error)


class Since(SubTree):
    """A part of the library, and the times between which files have changed."""

    def __init__(self, part: SubTree, start: float, end: float):
        super().__init__(part.path, part.recursive)
        self.start, self.end = start, end


class LibraryStreamReader(DataSourceStreamReader):
    """New and changed files, by the time at which the file system last changed them (which renames set, too).

    An offset is a time; a batch has the files that changed after its first and up to its last, so nothing needs
    to be remembered between batches and a batch that is run again gives what has not changed once more since. Offsets stay
    ``lag`` seconds behind the clock, so that no later file has an earlier time. A directory whose own entry changed while its
    list of files did not has been moved here or reopened: all below it is new. Files that cannot be read are left out.
    A batch looks at all files; it is the trigger that says how often. Removals are not seen."""

    def __init__(self, options: dict):
        self.reader, self.lag = LibraryReader(options), float(options.get("lag", 2))

    def initialOffset(self) -> dict:
        return {"changed": 0.0}

    def latestOffset(self) -> dict:
        return {"changed": time.time() - self.lag}

    def partitions(self, start: dict, end: dict) -> list[Since]:
        # what moves a directory may be above it: the parts that the driver makes are looked at as a whole in that case
        return [Since(p, start["changed"], end["changed"]) for p in self.reader.partitions()] if end["changed"] > start["changed"] else []

    def read(self, partition: Since) -> Iterator[tuple]:
        moved: dict[str, bool] = {}

        def came(path: str) -> bool:
            """Whether a directory, or one above it, has been moved into place since the start."""
            if path not in moved:
                info = os.stat(path)
                own = partition.start < info.st_ctime <= partition.end and info.st_ctime > info.st_mtime
                moved[path] = own or (len(path) > len(self.reader.root) and came(os.path.dirname(path)))
            return moved[path]

        for row in self.reader.read(partition):
            try:
                changed = os.stat(row[0]).st_ctime
                if row[2] is not None and changed <= partition.end and (changed > partition.start or came(os.path.dirname(row[0]))):
                    yield row
            except OSError:
                continue  # gone meanwhile


class Library(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "filepath string, name string, modified_at double, size long, reason string"

    def streamReader(self, schema) -> LibraryStreamReader:
        return LibraryStreamReader({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema) -> LibraryReader:
        return LibraryReader({k.lower(): v for k, v in self.options.items()})
