"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage and survives the loss of any executor. A job's tables stay as long as
its result may be read from them; ``finished`` removes those of the jobs inside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from mediasift.sources.shared import shared_dir

#: Spark then removes a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[Tables] = []


class Tables:
    """Named tables of one job, under a folder of its own."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        _open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write, and read what was written; the shuffle files of the writing go."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEAN_UP)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        """Where a saved table's files are, for tasks that go through them."""
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        self._delete(*[f"{self.root}/{name}" for name in names])

    def close(self) -> None:
        """Remove all tables; no result that reads them may be used any more."""
        self._delete(self.root)
        if self in _open:
            _open.remove(self)

    def _delete(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def finished() -> Iterator[None]:
    """Removes at its end the tables of the jobs begun inside; write their results first."""
    before = list(_open)
    yield
    for tables in [t for t in _open if t not in before]:
        tables.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
