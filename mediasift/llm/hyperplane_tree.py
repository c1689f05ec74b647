"""Hard negatives by a multiway hyperplane tree (a geometric near-neighbour access tree), exact.

Scores are inner products of whole-number vectors. A further coordinate sqrt(M - |x|^2), with M the greatest squared
length of all rows, puts every row on one sphere; an anchor has 0 there. The squared distance of an anchor a
and a row x is then |a|^2 + M - 2 * score, so a window of scores is an annulus around the anchor.

A node of the tree has some split points; a row belongs to the nearest of them (multiway hyperplanes). Each split point i
stores the least and greatest distance to the rows of every sibling j. A sibling j is left out when for some i the
interval cannot meet what the triangle inequality allows for the anchor's annulus. The annulus shrinks as good rows are found. Leaves are
compared exactly, by whole numbers, so the result is exact however little is left out.

The root is dealt over Spark: its split points come from a bounded sample of rows (``SAMPLE``), each task assigns its rows to them, and
each region is cut by a hash into blocks of about ``HELD_BYTES``; a block is a task's subtree, written to the shared
folder with its ranges to the root's split points. All rows are in the tree. Searches go through the written anchors, block of
the tree by block; what is shuffled is ``k`` rows for each anchor and block. A region of copies has no end of split
points that tell them apart: it is a leaf, cut by the hash all the same.

Rows without id or label, or whose vector is null or holds a null or non-finite component, take no part. Missing
last components count as zero. Components beyond ``whole_vectors.MOST`` count as that. An id that several rows share is one
anchor, by the least of its (label as text, vector), and rows of that id are neither positives nor negatives of
it; as positives and negatives of others each row counts. Ties go by the smaller id. An anchor with no other row of its label has
no rows, nor has a positive with nothing in its window. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from mediasift.llm.shared import Tables
from mediasift.llm.whole_vectors import EXACT, matrix, stored, usable, whole

#: Rows that the root's split points and the first windows are taken from; split points of the root and of a node; rows of a leaf.
SAMPLE, ROOT_POINTS, POINTS, LEAF = 1000, 32, 16, 256
#: Bytes of vectors in a block of the tree, and anchors that a task searches with at once.
HELD_BYTES, QUERY_BLOCK = 16 << 20, 2048
NONE = np.iinfo(np.int64).min + 1
RESULT = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])


def lift(v: np.ndarray, most: int) -> np.ndarray:
    """Rows with the coordinate that puts them on the sphere."""
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]])


def gaps(a: np.ndarray, b: np.ndarray, lengths: np.ndarray | float) -> np.ndarray:
    """Distances of rows of ``a`` and of ``b``; ``lengths`` is the sum of their squared lengths."""
    return np.sqrt(np.maximum(lengths - 2 * (a @ b.T), 0))


def spread_points(x: np.ndarray, n: int, most: int) -> np.ndarray:
    """Up to n different rows of a few random ones, each the farthest from those before it."""
    some = np.random.default_rng(len(x)).permutation(len(x))[: 3 * n]
    taken, near = [some[0]], gaps(x[some], x[some[:1]], 2.0 * most)[:, 0]
    while len(taken) < n and near.max() > 1e-6 * np.sqrt(2.0 * most):
        taken.append(some[int(near.argmax())])
        near = np.minimum(near, gaps(x[some], x[taken[-1:]], 2.0 * most)[:, 0])
    return x[taken]


def ranges(points: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each point to the rows."""
    low, high = np.full(len(points), np.inf), np.zeros(len(points))
    for lo in range(0, len(x), 8192):
        d = gaps(points, x[lo : lo + 8192], 2.0 * most)
        low, high = np.minimum(low, d.min(axis=1)), np.maximum(high, d.max(axis=1))
    return low, high


def nearest(points: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    return np.concatenate([gaps(x[lo : lo + 8192], points, 2.0 * most).argmin(axis=1) for lo in range(0, len(x), 8192)])


class Rows:
    """Rows by id, with labels as numbers."""

    def __init__(self, ids: np.ndarray, labels: list[str], v: np.ndarray, most: int):
        names, codes = np.unique(np.array(labels, object), return_inverse=True)
        self.names = {name: k for k, name in enumerate(names)}
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.v, self.most = ids[order], codes[order], v[order], most


class Tree(Rows):
    """One block, its rows in the order of leaves, by id inside a leaf; nodes are (points, low, high, children), leaves (start, end)."""

    def __init__(self, ids: np.ndarray, labels: list[str], v: np.ndarray, most: int, root_points: np.ndarray):
        super().__init__(ids, labels, v, most)
        x, order = lift(self.v, most), []
        self.root = ranges(root_points, x, most)
        self.top = self._node(x, np.arange(len(x)), order)
        at = np.concatenate(order)
        self.ids, self.codes, self.v = self.ids[at], self.codes[at], self.v[at]

    def _node(self, x: np.ndarray, at: np.ndarray, order: list[np.ndarray]) -> tuple:
        if len(at) > LEAF:
            points = spread_points(x[at], POINTS, self.most)
            own = nearest(points, x[at], self.most)
            parts = [at[own == j] for j in range(len(points))]
            if max(map(len, parts)) < len(at):
                points, parts = points[[bool(len(p)) for p in parts]], [p for p in parts if len(p)]
                bounds = [ranges(points, x[p], self.most) for p in parts]
                low, high = np.stack([b[0] for b in bounds]), np.stack([b[1] for b in bounds])
                return points, low, high, [self._node(x, p, order) for p in parts]
        start = sum(map(len, order))
        order.append(at)
        return start, start + len(at)


class Search:
    """The k best rows of one tree for each of some anchors, inside their windows."""

    def __init__(self, rows: Rows, anchors: np.ndarray, own: np.ndarray, labels: list[str], same: bool, least: np.ndarray, most: np.ndarray, k: int):
        self.rows, self.k, self.same, self.own = rows, k, same, own
        self.codes = np.array([rows.names.get(x, -1) for x in labels])
        self.least, self.most = least.copy(), most
        largest = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows.v).max(initial=0)) * anchors.shape[1]
        self.kind = np.float64 if largest < EXACT else np.int64
        self.exact, floats = anchors.astype(self.kind), anchors.astype(np.float64)
        self.lifted = np.hstack([floats, np.zeros((len(anchors), 1))])
        self.lengths = (floats**2).sum(axis=1) + rows.most
        self.slack = 1e-6 * np.sqrt(self.lengths)
        self.score = np.full((len(anchors), k), NONE)
        self.found = np.zeros((len(anchors), k), np.int64)
        self.compared = 0

    def radius(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.lengths[at] - 2.0 * score, 0))

    def allowed(self, low: np.ndarray, high: np.ndarray, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Anchors whose annulus can meet rows that are between low and high from each split point."""
        outer, inner, slack = self.radius(self.least[at], at), self.radius(self.most[at], at), self.slack[at]
        nearest = np.maximum(d - (outer + slack)[:, None], (inner - slack)[:, None] - d)
        return ((high >= nearest) & (low <= d + (outer + slack)[:, None])).all(axis=1) & (self.least[at] <= self.most[at])

    def run(self, root_points: np.ndarray) -> None:
        at = np.arange(len(self.lifted))
        at = at[self.allowed(*self.rows.root, gaps(self.lifted, root_points, self.lengths[:, None]), at)]
        if len(at):
            self.visit(self.rows.top, at)

    def visit(self, node: tuple, at: np.ndarray) -> None:
        if len(node) == 2:
            return self.leaf(*node, at)
        points, low, high, children = node
        d = gaps(self.lifted[at], points, self.lengths[at, None])
        for j in np.argsort(d.mean(axis=0)).tolist():  # the nearest first: the windows shrink early
            ok = self.allowed(low[j], high[j], d, at)
            if ok.any():
                self.visit(children[j], at[ok])

    def leaf(self, start: int, end: int, at: np.ndarray) -> None:
        t = self.rows
        for lo in range(start, end, 4096):  # a leaf of copies is of any size
            hi = min(lo + 4096, end)
            self.compared += len(at) * (hi - lo)
            n = hi - lo
            score = (self.exact[at] @ t.v[lo:hi].T.astype(self.kind)).astype(np.int64)
            ok = (t.codes[lo:hi] == self.codes[at, None]) == self.same
            ok &= (t.ids[lo:hi] != self.own[at, None]) & (score >= self.least[at, None]) & (score <= self.most[at, None])
            hit = np.flatnonzero(ok.any(axis=1))
            if not len(hit):
                continue
            mine, score = at[hit], np.where(ok[hit], score[hit], NONE)
            if n > self.k:
                kth = np.partition(score, n - self.k, axis=1)[:, n - self.k, None]
                # rows are in the order of ids: of those at the k-th score the first ones stay
                tied = (score == kth) & (kth > NONE)
                keep = (score > kth) | tied & (np.cumsum(tied, axis=1) <= self.k - (score > kth).sum(axis=1, keepdims=True))
                pick = np.argsort(~keep, axis=1, kind="stable")[:, : self.k]
                score, ids = np.where(np.take_along_axis(keep, pick, 1), np.take_along_axis(score, pick, 1), NONE), t.ids[lo:hi][pick]
            else:
                ids = np.broadcast_to(t.ids[lo:hi], score.shape)
            score, ids = np.hstack([self.score[mine], score]), np.hstack([self.found[mine], ids])
            order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
            self.score[mine], self.found[mine] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
            self.least[mine] = np.maximum(self.least[mine], self.score[mine, -1])


def runs(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Rows of equal keys, which follow each other, in tables of about ``size`` bytes."""
    held, n, last = [], 0, None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and (keys[lo] != last or n >= size):
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(batch.slice(lo, hi - lo))
            n, last = n + held[-1].nbytes, keys[lo]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Index:
    """A tree over all rows (id long, label string, v array<int>), in blocks of files in the shared folder."""

    def __init__(self, tables: Tables, rows: DataFrame):
        self.spark: SparkSession = rows.sparkSession
        size = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x.cast("long"))
        n, most, width = rows.agg(F.count(F.lit(1)), F.max(size), F.max(F.size("v"))).first()
        self.n, self.most, self.width = n, most or 0, max(width or 0, 1)
        if not n:
            return
        hashed = F.xxhash64("id", "label", "v")
        few = rows.orderBy(hashed, "id").limit(SAMPLE).collect()  # SAMPLE rows
        vectors = matrix(pa.array([list(r["v"]) for r in few], pa.list_(pa.int32())), self.width)
        self.sample = Rows(np.array([r["id"] for r in few]), [r["label"] for r in few], vectors, self.most)
        self.points = spread_points(lift(self.sample.v, self.most), ROOT_POINTS, self.most)
        points, most, width = self.points, self.most, self.width

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = nearest(points, lift(matrix(batch.column(2), width), most), most)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "label", "v", "region"])

        dealt = tables.save(rows.select("id", "label", "v").mapInArrow(assign, "id long, label string, v array<int>, region int"), "regions")
        blocks = {r["region"]: -(-r["count"] * 4 * width // HELD_BYTES) for r in dealt.groupBy("region").count().collect()}  # ROOT_POINTS rows
        first = dict(zip(blocks, np.cumsum([0, *blocks.values()]).tolist(), strict=False))
        share = F.create_map(*[F.lit(x) for r in blocks for x in (r, blocks[r])])[F.col("region")]
        start = F.create_map(*[F.lit(x) for r in blocks for x in (r, first[r])])[F.col("region")]
        cut = dealt.select("id", "label", "v", (start + F.pmod(hashed, share)).cast("long").alias("block"))
        total = sum(blocks.values())
        ordered = cut.repartition(total, "block").sortWithinPartitions("block", "id", "label", "v")
        root = tables.path("trees")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in runs(batches, "block", 8 * HELD_BYTES):
                tree = Tree(held.column("id").to_numpy(), held.column("label").to_pylist(), matrix(held.column("v"), width), most, points)
                name = uuid.uuid4().hex  # an attempt's own: only names of attempts that succeed are kept
                files, folder = fs.FileSystem.from_uri(root)
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{name}") as f:
                    f.write(pickle.dumps(tree))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(tree.ids)])], names=["tree", "n"])

        self.root, self.trees = root, tables.save(ordered.mapInArrow(build, "tree string, n long"), "names")
        self.tasks = max(1, min(self.trees.count(), 4096))

    def search(self, tables: Tables, name: str, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """own, nth, id, score, rk: the k best rows, of the anchor's label or of others, for each of ``asked`` (own
        long: the anchor's id; nth int; label string; v array<int>; low, high long: the least and greatest score)."""
        points, width, sample, root = self.points, self.width, self.sample, self.root

        def begin(part: pa.RecordBatch, rows: Rows) -> Search:
            own, labels = part.column("own").to_numpy(), part.column("label").to_pylist()
            return Search(rows, matrix(part.column("v"), width), own, labels, same, part.column("low").to_numpy(), part.column("high").to_numpy(), k)

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # k rows of the sample inside a window raise its lower end for all rows
            for batch in batches:
                for lo in range(0, batch.num_rows, QUERY_BLOCK):
                    part = batch.slice(lo, QUERY_BLOCK)
                    s = begin(part, sample)
                    s.leaf(0, len(sample.ids), np.arange(part.num_rows))
                    yield part.set_column(part.schema.get_field_index("low"), "low", pa.array(s.least))

        schema = "own long, nth int, label string, v array<int>, low long, high long"
        tables.save(asked.select("own", "nth", "label", "v", "low", "high").mapInArrow(narrow, schema), name)
        path = tables.path(name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, folder = fs.FileSystem.from_uri(root)
            for tree_name in (x for batch in batches for x in batch.column(0).to_pylist()):
                with files.open_input_stream(f"{folder}/{tree_name}") as f:
                    tree = pickle.loads(f.read())
                for part in stored(path, QUERY_BLOCK):
                    s = begin(part, tree)
                    s.run(points)
                    row, at = np.nonzero(s.score > NONE)
                    yield pa.RecordBatch.from_arrays([part.column("own").take(pa.array(row)), part.column("nth").take(pa.array(row)), pa.array(s.found[row, at]), pa.array(s.score[row, at])], names=["own", "nth", "id", "score"])

        found = self.trees.select("tree").repartition(self.tasks).mapInArrow(run, "own long, nth int, id long, score long")
        order = W.partitionBy("own", "nth").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """For the rows where ``anchors`` holds and each of their best ``positives`` rows of the same label: the best ``negatives`` of
    other labels that score from ``percent`` percent of the positive's score up to that score."""
    if min(positives, negatives) < 1:
        raise ValueError("positives and negatives must be at least 1")
    spark, tables = rows.sparkSession, Tables(rows.sparkSession, "negatives")
    label = label if isinstance(label, Column) else F.col(f"`{label}`")
    taking = rows.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & usable(F.col(f"`{vector}`")))
    taking = taking.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), whole(F.col(f"`{vector}`"), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    index = Index(tables, taking)
    if not index.n:
        return spark.createDataFrame([], RESULT)
    asked = taking.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
    asked = tables.save(asked.select(F.col("id").alias("own"), "x.label", "x.v"), "anchors")
    every = asked.select("*", F.lit(0).alias("nth"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    best = index.search(tables, "asked-positives", every, True, positives)
    pairs = tables.save(best.select("own", F.col("rk").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the least whole score that is not below the percentage; above the positive's score if that is negative
    low = F.expr(f"cast(({percent} * cast(positive_score as decimal(25, 0)) + if(positive_score > 0, 99, 0)) div 100 as bigint)")
    windows = pairs.join(asked, "own").select("own", "nth", "label", "v", low.alias("low"), F.col("positive_score").alias("high"))
    found = index.search(tables, "asked-negatives", windows, False, negatives)
    return found.join(pairs, ["own", "nth"]).select(F.col("own").alias("anchor_id"), "positive_id", F.col("rk").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
