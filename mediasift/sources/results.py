"""A Spark sink for search results: one text file with a header, ordered rows, and a header alone when there are none.

``rows.write.format("results").option("path", file).mode("append").save()`` writes ``score`` with three decimals, a tab and the
quoted ``filepath``; with ``pathsOnly`` the paths alone, without a header. Tasks write their rows beside the file; the
driver then puts the parts together in the order of partitions, so ordered rows stay in order, and renames the whole into place:
readers see the file complete or not at all. An older file is replaced.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from mediasift.sources.files import place_of

HEADER = "score\tfilepath\n"


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


class ResultWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.paths_only = options["path"], str(options.get("pathsonly", "false")).lower() == "true"
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        place, context = place_of(self.path), TaskContext.get()
        name = f"{place.inner(self.parts)}/{context.partitionId():08d}-{context.taskAttemptId()}"
        place.files.create_dir(place.inner(self.parts), recursive=True)
        with place.files.open_output_stream(name) as out:
            for r in iterator:
                out.write((f"{r['filepath']}\n" if self.paths_only else f'{r["score"]:.3f}\t"{r["filepath"]}"\n').encode())
        return Part(context.partitionId(), name)

    def commit(self, messages: list[Part | None]) -> None:
        place = place_of(self.path)
        files, fresh = place.files, place.inner(self.parts) + ".whole"
        with files.open_output_stream(fresh) as out:
            if not self.paths_only:
                out.write(HEADER.encode())
            for part in sorted((m for m in messages if m), key=lambda m: m.number):
                with files.open_input_stream(part.name) as source:
                    shutil.copyfileobj(source, out, 1 << 20)
        files.move(fresh, place.inner(self.path))
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        place = place_of(self.path)
        if place.files.get_file_info(place.inner(self.parts)).type == fs.FileType.Directory:
            place.files.delete_dir(place.inner(self.parts))


class Results(DataSource):
    @classmethod
    def name(cls) -> str:
        return "results"

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        return ResultWriter({k.lower(): v for k, v in self.options.items()})


def write_results(rows: DataFrame, path: str, *, paths_only: bool = False) -> None:
    """Writes rows (filepath, score), in their order, to one file."""
    rows.sparkSession.dataSource.register(Results)
    rows.select("filepath", "score").write.format("results").option("path", path).option("pathsOnly", str(paths_only).lower()).mode("append").save()
