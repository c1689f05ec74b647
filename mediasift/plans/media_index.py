"""The library as a whole: keep an index of a directory and search it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions import terms as Q
from mediasift.functions.media import parse_cap
from mediasift.functions.paths import IMAGE_EXTENSIONS, RAW_EXTENSIONS, exclude_regex, extension_regex
from mediasift.operators import images as im
from mediasift.operators import index as ix
from mediasift.operators import listing_filters as lf
from mediasift.operators import search as sr
from mediasift.sources.content import content_of, fingerprints
from mediasift.sources.walk import list_library
from mediasift.streaming.upsert import stream_upsert
from mediasift.sources.listing import Library
from mediasift.sources.store import IndexStore


def executor(spark: SparkSession) -> tuple[int, int]:
    """Bytes of memory of an executor and tasks that it runs at once, as the session has them."""
    context, conf = spark.sparkContext, spark.sparkContext.getConf()
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    workers = context.defaultParallelism if local else int(conf.get("spark.executor.cores", "1")) // int(conf.get("spark.task.cpus", "1"))
    return context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory), max(1, workers)


class MediaIndex:
    """``make_encoder`` gives, in each worker, a function of a batch of images (n x 3 x 256 x 256) to vectors;
    ``encode_text`` maps a phrase to a unit vector; ``decode`` maps a file's bytes to height x width x 3 bytes. The automatic pixel cap is that of an executor's ``memory`` and
    ``workers`` (0: the session's)."""

    def __init__(
        self, spark: SparkSession, store: str, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], encode_text: Callable[[str], list[float]], *,
        decode: Callable[[bytes], np.ndarray] = im.decode_image, batch: int = 8, max_image_megapixels: str = "auto", memory: int = 0, workers: int = 0,
        exclude_dirs: list[str] | None = None, include_hidden: bool = False, raw_support: bool = False, read: Callable[[str], bytes] = content_of,
    ):
        self.spark, self.store = spark, IndexStore(spark, store)
        self.make_encoder, self.encode_text, self.decode, self.read, self.batch = make_encoder, encode_text, decode, read, batch
        own_memory, own_workers = executor(spark)
        self.cap = parse_cap(max_image_megapixels, memory or own_memory, workers or own_workers)
        self.counts: dict[str, int] = {}
        self.exclude_dirs, self.include_hidden, self.raw_support = exclude_dirs, include_hidden, raw_support

    def refresh(self, directory: str, *, restore_deleted: bool = True) -> DataFrame:
        """Lists the directory, opens what is new or changed, encodes what is not yet known by content, and adds the rows and marks
        that differ to the index. Returns the files that were left out: filepath, reason, message. ``counts`` then has visited, unchanged,
        new, changed, gone, restored, written and marked rows, and those skipped."""
        try:
            return self._refresh(directory, restore_deleted)
        finally:
            self.store.release()

    def _refresh(self, directory: str, restore_deleted: bool) -> DataFrame:
        hold = self.store.hold
        listed = list_library(self.spark, directory, hidden=self.include_hidden, exclude_dirs=self.exclude_dirs, raw_support=self.raw_support, hold=hold)
        listing = (lf.without_shadowed_raw(listed) if self.raw_support else listed).where("modified_at is not null").drop("name", "reason")
        skipped = [listed.where("modified_at is null").select("filepath", F.lit("unreadable").alias("reason"), F.col("reason").alias("message"))]
        manifest = self.store.manifest()

        def load(rows: DataFrame) -> DataFrame:
            found = hold(fingerprints(rows))
            skipped.append(found.where("error is not null").select("filepath", F.lit("unreadable").alias("reason"), F.col("error").alias("message")))
            return found.where("error is null").drop("error")

        def encode(rows: DataFrame) -> DataFrame:
            found = hold(im.encode_images(rows, self.make_encoder, decode=self.decode, cap=self.cap, batch=self.batch, read=self.read))
            skipped.append(found.where("reason is not null").select("filepath", "reason", "message"))
            return found.where("reason is null")

        rows, marks, counts = ix.delta(listing, self.store.read(manifest), directory, load, encode, within=self.store.read(manifest, directory), restore_deleted=restore_deleted, hold=hold)
        report = skipped[0]
        for x in skipped[1:]:
            report = report.unionByName(x)
        path = f"{self.store.root}/skipped-{uuid.uuid4().hex}"
        report.write.parquet(path)
        if manifest is None or rows is not None or marks is not None:
            self.store.add(rows, manifest, marks=marks)
        report = self.spark.read.schema("filepath string, reason string, message string").parquet(path)
        self.counts = {**counts, "skipped": report.count()}
        return report

    def follow(self, directory: str, checkpoint: str, *, available_now: bool = True, lag: float = 2.0):
        """Starts a query that adds the directory's new and changed files to the index as they come; files that fail are left out.

        The directory is a path that all executors see. Removals are seen by ``refresh`` alone, which may run beside it."""
        self.spark.dataSource.register(Library)
        extensions = IMAGE_EXTENSIONS + (RAW_EXTENSIONS if self.raw_support else [])
        options = {"root": directory, "hidden": str(self.include_hidden).lower(), "excludeDirs": exclude_regex(self.exclude_dirs), "files": extension_regex(extensions), "lag": str(lag)}
        stream = self.spark.readStream.format("library").options(**options).load()

        def load(rows: DataFrame) -> DataFrame:
            return fingerprints(rows).where("error is null").drop("error")

        def encode(rows: DataFrame) -> DataFrame:
            return im.encode_images(rows, self.make_encoder, decode=self.decode, cap=self.cap, batch=self.batch, read=self.read).where("reason is null")

        return stream_upsert(stream, self.store, checkpoint, encode, scope=directory, available_now=available_now, load=load)

    def encode_image(self, raw: bytes) -> list[float]:
        """The unit vector of one image; a query image is not held to the pixel cap."""
        found = np.asarray(self.make_encoder()(im.load_image(raw, self.decode, None)[None]), np.float64)[0]
        return (found / np.linalg.norm(found)).tolist()

    def query_vector(self, kind: str, body: str, images: Mapping[str, bytes]) -> list[float]:
        """Of a phrase; of a file in the index, or else of its bytes; of a URL whose bytes are given."""
        if kind == "phrase":
            return self.encode_text(body)
        if body in images:
            return self.encode_image(images[body])
        if kind == "url":
            raise ValueError(f"give the bytes of {body} as images[{body!r}]")
        path = body.removeprefix("file://")
        found = self.store.read(path=path).where((F.col("filepath") == path) & F.col("deleted").isNull()).select("vector").first()
        return [float(x) for x in found[0]] if found else self.encode_image(self.read(path))

    def search(self, directory: str, query: str, add: list[str] | None = None, subtract: list[str] | None = None, *, top: int = 10, refresh: bool = True, images: Mapping[str, bytes] | None = None) -> DataFrame:
        """filepath and score of the best files below a directory; queries may be phrases, files or URLs.

        ``images`` has the bytes of query images by the query that names them, such as URLs."""
        if refresh:
            self.refresh(directory)
        signed = [(1.0, q) for q in [query, *(add or [])]] + [(-1.0, q) for q in subtract or []]
        rows = self.spark.createDataFrame(signed, "sign double, q string").select("sign", "q", Q.parse(F.col("q")).alias("t")).select("sign", "q", "t.*").collect()
        vectors = [self.query_vector(r["kind"], r["body"], images or {}) for r in rows]
        weights = [r["sign"] * r["multiplier"] for r in rows]
        files = [r["q"] for r in rows if r["kind"] == "file" and r["q"] == r["body"]]
        return sr.search(ix.scan(self.store.read(scope=directory), directory), sr.combine(vectors, weights, len(vectors[0])), top=top, exclude_dirs=self.exclude_dirs, query_files=files)
