"""Self-join of documents on the Jaccard similarity of their sets of five-word shingles.

1. Sketch: each text becomes the hash of its shingle set, the set's size and ``HASHES`` MinHash
   values. Documents with equal sets are one class, however many copies there are.
2. Candidates: classes that agree on all values of a band share a bucket. Buckets with the same
   members are taken once. A bucket goes to one task up to ``SKETCH_BLOCK`` members (16 MB of sketches);
   a larger one is dealt as pairs of blocks of that size. No pair is ever written out.
3. Bayesian pruning: in each block the MinHash values of a pair are compared ``STEP`` at a time; a
   pair is dropped as soon as the posterior probability that its similarity reaches the threshold,
   given the agreements so far and a uniform prior, is below ``TOLERANCE``. The block emits
   a spanning forest of what is left, and compares only what is not yet in one tree: near copies of one text
   are compared with the first of them alone. Components of these forests are the sets to verify.
4. Verification: one text of each class becomes its set of shingle hashes, once. The sets of a component meet in
   one task up to ``SET_BYTES``. In a larger component each set is first compared with the set of its smallest node: two sets
   that differ from it by a ninth of their own size at most differ from each other by a ninth of both at most, which is
   the threshold, so all these tight sets are linked and need only be counted, once each. Pairs with
   a set that is not tight are dealt as pairs of blocks of that size. Exact
   intersections of their pairs give the links, which are counted with copies, and
   components of the true links are the result's classes.

The shingles are runs of five words (``[^\\x20\\x09-\\x0D]+``, as written); a text of one to four
words has one shingle of all its words. Null texts and texts without words are in classes of their
own without links. A class id is the smallest doc_id of its class (null if all are null). Repeated
rows are copies of each other and each gets a row. Only the key and the text are read, so clashing
names cannot matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.arrow_text import Block, Words, blocks, mix, text_bytes, windows
from mediasift.llm.components import components
from mediasift.llm.shared import Tables

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 two sets miss all 32 bands of 4 with a probability of 5e-8.
HASHES, BAND = 128, 4
STEP, TOLERANCE = 32, 1e-6
#: A block: members when pruning, bytes of shingle hashes when verifying; sets whose pairs are intersected at once.
SKETCH_BLOCK, SET_BYTES, TILE = 32_768, 8 << 20, 1024
#: Bytes of hubs' sets that are broadcast; beyond, both sides are shuffled.
HUB_BYTES = 64 << 20
#: Up to so many rows of (doc_id, class), and of (component, bytes), are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000

_random = np.random.Generator(np.random.PCG64(5))
_XOR = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _random.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin."""
    words = Words(block)
    h, ok = windows(words.hashes, words.first, SHINGLE)
    count = np.diff(words.first)
    out, place = [h[ok]], [np.flatnonzero(ok)]
    for n in range(1, SHINGLE):
        if (count == n).any():
            g, own = windows(words.hashes, words.first, n)
            at = np.flatnonzero(own & (count[words.row[: len(g)]] == n))
            out.append(mix(g[at] + np.uint64(n)))
            place.append(at)
    at = np.concatenate(place)
    order = np.argsort(at, kind="stable")
    h = np.concatenate(out)[order]
    row = words.row[at[order]]
    first = np.searchsorted(row, np.arange(len(block) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    kept = np.flatnonzero(new)
    return h[kept], np.searchsorted(row[kept], np.arange(len(block) + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each set; none for an empty one."""
    full = np.flatnonzero(np.diff(first))
    out: list[bytes | None] = [None] * (len(first) - 1)
    if len(full):
        a = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first[full])
        b = np.add.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), first[full])
        raw = np.stack([a, mix(b + np.diff(first)[full].astype(np.uint64))], axis=1).astype(">u8").tobytes()
        for k, i in enumerate(full.tolist()):
            out[i] = raw[16 * k : 16 * k + 16]
    return out


def signatures(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    full = np.flatnonzero(np.diff(first))
    out: list[bytes | None] = [None] * (len(first) - 1)
    if len(full):
        low, at = (h >> np.uint64(32)).astype(np.uint32), first[full]
        sig = np.empty((len(full), HASHES), "<u4")
        for k in range(HASHES):
            sig[:, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], at)
        for k, i in enumerate(full.tolist()):
            out[i] = sig[k].tobytes()
    return out


def prune_table(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values: the least number of agreements with which a pair stays.

    With a uniform prior the posterior after m agreements of n is Beta(m + 1, n - m + 1), whose
    tail above t is the probability of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, table: dict[int, int]) -> np.ndarray:
    """Which rows of two aligned arrays of signatures are never dropped."""
    live, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in table.items():
        same[live] += (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(axis=1)
        live = live[same[live] >= least]
    return live


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, first = shingles(block)
                own = [batch.column(k).slice(block.lo, len(block)) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(set_keys(h, first), pa.binary()), pa.array(signatures(h, first), pa.binary())], names=["doc_id", "th", "node", "sig"]).append_column("size", pa.array(np.diff(first)))

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, node binary, sig binary, size long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in batches sorted by them; a run that spans batches is put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k)
            v = v.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        cuts = np.flatnonzero(change).tolist()
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, group: str, node: str, blocks: Column) -> DataFrame:
    """Rows of each group copied to the pairs of blocks (i <= j) that need them; ``side`` is the row's block.
    A group of one block is not copied."""
    own = F.pmod(F.xxhash64(node, group), F.col("n")).cast("int")
    out = rows.withColumn("n", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("side", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")


def tight(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows (comp, bytes, node, copies, set) with ``hub``, the smallest node of the component, and ``near``: whether the set
    differs from the hub's by a ninth of its size at most."""
    # a row a large component
    hubs = tables.save(rows.groupBy("comp").agg(F.min("node").alias("hub"), F.min_by("set", "node").alias("hub_set")), "hubs")
    size = hubs.agg(F.coalesce(F.sum(F.octet_length("hub_set")), F.lit(0))).first()[0]
    met = rows.join(F.broadcast(hubs) if size <= HUB_BYTES else hubs, "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hub = (text_bytes(batch.column(c)) for c in ("set", "hub_set"))
            near = []
            for k in range(batch.num_rows):
                a, b = (data[off[k] : off[k + 1]].view("<u8") for data, off in (own, hub))
                near.append(9 * len(np.setxor1d(a, b, assume_unique=True)) <= len(a))
            yield batch.drop_columns(["hub_set"]).append_column("near", pa.array(near, pa.bool_()))

    return met.select("comp", "bytes", "node", "copies", "set", "hub", "hub_set").mapInArrow(run, "comp binary, bytes long, node binary, copies long, set binary, hub binary, near boolean")


def counted_links(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """For the rows of large components: what is left to ``verify``, and the links among tight sets (node, links, hub)."""
    rows = tables.save(rows.dropDuplicates(["comp", "node"]), "large-sets")
    marked = tables.save(tight(rows, tables), "tight")
    width = F.octet_length("set").cast("long")
    sums = marked.groupBy("comp").agg(F.sum(F.when(F.col("near"), F.col("copies"))).alias("n_near"), *[F.ceil(F.coalesce(F.sum(F.when(c, width)), F.lit(0)) / F.lit(SET_BYTES)).cast("int").alias(n) for n, c in (("near_blocks", F.col("near")), ("far_blocks", ~F.col("near")))])
    sums = small(tables.save(sums, "tight-sums"))
    met = marked.join(sums, "comp")
    links = met.where("near").select("node", (F.col("n_near") - F.col("copies")).alias("links"), "hub")
    # blocks of sets that are not tight come first; a tight block meets those alone
    place = F.xxhash64("node", "comp")
    side = F.when(F.col("near"), F.col("far_blocks") + F.pmod(place, F.greatest("near_blocks", F.lit(1)))).otherwise(F.pmod(place, F.greatest("far_blocks", F.lit(1)))).cast("int")
    out = met.where("far_blocks > 0").withColumn("side", side).withColumn("n", F.lit(2))
    last = F.when(F.col("near"), F.col("far_blocks")).otherwise(F.col("far_blocks") + F.col("near_blocks")) - 1
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    out = out.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    return out.select("comp", "i", "j", "n", "side", "node", "copies", "set"), links


def by_group(rows: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def candidate_edges(tables: Tables, nodes: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the pairs that survive the pruning."""
    bands = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * BAND) + 1, F.lit(4 * BAND))))).alias("band", "bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node") % (1 << 40)).alias("s")).where("members > 1")
    kept = sizes.groupBy("members", "x", "s").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", "members")
    kept = tables.save(kept, "buckets")
    members = tables.save(bands.select("bucket", "node").join(kept, "bucket"), "members")
    rows = dealt(members.join(nodes.select("node", "sig"), "node"), "bucket", "node", F.ceil(F.col("members") / F.lit(SKETCH_BLOCK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prune_table()
        left, right, size = [], [], 0
        for g in groups(batches, ["bucket", "i", "j"]):
            names = g.column("node").combine_chunks()
            sig = text_bytes(g.column("sig"))[0].view("<u4").reshape(len(names), HASHES)
            tree = spanning(sig, g.column("side").to_numpy(), table)
            some = np.flatnonzero(tree != np.arange(len(names)))
            left.append(names.take(pa.array(tree[some])))
            right.append(names.take(pa.array(some)))
            size += len(some)
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(left), pa.concat_arrays(right)], names=["a", "b"])
                left, right, size = [], [], 0
        if left:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(left), pa.concat_arrays(right)], names=["a", "b"])

    return by_group(rows.select("bucket", "i", "j", "side", "node", "sig"), ["bucket", "i", "j"], run, "a binary, b binary")


def spanning(sig: np.ndarray, side: np.ndarray, table: dict[int, int]) -> np.ndarray:
    """The first row of each row's tree, of the pairs that survive; if there are two sides, of pairs across them."""
    n = len(sig)
    tree, split = np.arange(n), (side != side[0]).any()
    todo, at = np.arange(n), 0
    while at < len(todo):
        k = todo[at]
        at += 1
        mates = todo[at:] if not split else todo[at:][side[todo[at:]] != side[k]]
        mates = mates[tree[mates] != tree[k]]
        if not len(mates):
            # all that follow are in this tree: none of their pairs can join another
            if not split and not len(np.flatnonzero(tree[todo[at:]] != tree[k])):
                break
            continue
        found = mates[surviving(np.broadcast_to(sig[k], (len(mates), HASHES)), sig[mates], table)]
        if len(found):
            joined = np.unique(np.append(tree[found], tree[k]))
            tree[np.isin(tree, joined)] = joined[0]
    return tree


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``, in tiles."""
    if len(left) * len(right) <= 16:
        yield left, right, np.array([[len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in right] for a in left]).reshape(len(left), len(right))
        return
    used = np.union1d(left, right)
    row = np.repeat(used, [len(sets[i]) for i in used])
    _, code, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    keep = count[code] > 1
    row, code = row[keep], code[keep]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    for a in range(0, len(left), TILE):
        for b in range(0, len(right), TILE):
            x, y = left[a : a + TILE], right[b : b + TILE]
            yield x, y, shared(row, code, x, y)


def shared(row: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Counts of equal codes of two lists of rows; row and code are sorted, rows and codes being distinct pairs."""

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
        size = hi - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.repeat(np.arange(len(rows)), size), code[at]

    (r1, c1), (r2, c2) = part(left), part(right)
    both = np.intersect1d(c1, c2)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for r, c in ((r1, c1), (r2, c2)):
        col = np.minimum(np.searchsorted(both, c), max(len(both) - 1, 0))
        ok = both[col] == c if len(both) else np.zeros(len(c), bool)
        order = np.argsort(col[ok], kind="stable")
        sides.append((r[ok][order], col[ok][order]))
    for c in range(0, len(both), width):
        tiles = []
        for (r, col), n in zip(sides, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(col, [c, c + width])
            x = np.zeros((n, min(width, len(both) - c)), np.float32)
            x[r[lo:hi], col[lo:hi] - c] = 1
            tiles.append(x)
        out += tiles[0] @ tiles[1].T
    return np.rint(out).astype(np.int64)


def as_sets(rows: DataFrame) -> DataFrame:
    """comp, bytes, node, copies, text to comp, bytes, node, copies, set (sorted shingle hashes). A text that has another
    set than its class's (hashes of texts may clash) goes, and a task gives a class's set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for block in blocks(batch.column(4)):
                h, first = shingles(block)
                keys = set_keys(h, first)
                want = batch.column(2).slice(block.lo, len(block)).to_pylist()
                pick = [k for k, (a, b) in enumerate(zip(keys, want, strict=True)) if a == b and a not in seen and not seen.add(a)]
                if pick:
                    sets = pa.array([h[first[k] : first[k + 1]].tobytes() for k in pick], pa.binary())
                    at = pa.array(np.array(pick) + block.lo)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(4)], sets], names=["comp", "bytes", "node", "copies", "set"])

    return rows.mapInArrow(run, "comp binary, bytes long, node binary, copies long, set binary")


def verify(rows: DataFrame) -> DataFrame:
    """Exact links inside components; rows: comp, i, j, n, side, node, copies, set.

    Gives (node, links) and, as rows with a root, a forest of the true links."""
    schema = "node binary, links long, root binary, whole boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["comp", "i", "j"]):
            names = g.column("node").to_pylist()
            pick = np.array(list({x: k for k, x in enumerate(names)}.values()), np.int64)  # a set comes from several tasks if its document is repeated
            data, off = text_bytes(g.column("set"))
            sets = [data[off[k] : off[k + 1]].view("<u8") for k in pick]
            names = [names[k] for k in pick]
            side = g.column("side").to_numpy()[pick]
            copies = g.column("copies").to_numpy()[pick]
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets])
            links = np.zeros(len(names), np.int64)
            tree = np.arange(len(names))
            for x, y, both in intersections(sets, left, right):
                linked = both * 5 >= (size[x][:, None] + size[y][None, :] - both) * 4
                linked &= x[:, None] != y[None, :]
                links[x] += linked @ copies[y]
                if i != j:
                    links[y] += linked.T @ copies[x]
                for k in np.flatnonzero(linked.any(axis=1)).tolist():
                    joined = np.unique(np.append(tree[y[linked[k]]], tree[x[k]]))
                    if len(joined) > 1:
                        tree[np.isin(tree, joined)] = joined[0]
            order = np.array(sorted(range(len(names)), key=names.__getitem__))
            best = np.full(len(names), -1)
            best[tree[order[::-1]]] = order[::-1]  # the smallest node of each tree
            root = [names[k] for k in best[tree]]
            whole = g.column("n")[0].as_py() == 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links), pa.array(root, pa.binary()), pa.array([whole] * len(names))], names=["node", "links", "root", "whole"])

    return by_group(rows, ["comp", "i", "j"], run, schema)


def small(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def verified_classes(docs: DataFrame, key: str, text: str) -> tuple[Tables, DataFrame, DataFrame]:
    """The job's tables, the sketches, and a row per set of shingles: node, lead and th (the smallest id
    with the set, and the hash of its text), copies, links, root (the same for all sets of a class)."""
    tables = Tables(docs.sparkSession, "jaccard")
    sketches = tables.save(sketch(docs, key, text), "sketches")
    # a class's text is that of its smallest id, or of any document if all ids are null
    lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    nodes = sketches.where("node is not null").groupBy("node").agg(lead.alias("l"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = tables.save(nodes.select("node", F.col("l.doc_id").alias("lead"), F.col("l.th").alias("th"), "copies", "sig", "size"), "nodes")
    edges = tables.save(candidate_edges(tables, nodes), "edges")
    comps = components(tables, edges, "candidates")
    members = tables.save(comps.join(nodes.select("node", "lead", "th", "copies", "size"), "node").select(F.col("root").alias("comp"), "node", "lead", "th", "copies", "size"), "in-components")
    # written first: a large component's rows meet its size without being dealt by it, or can be split
    bytes_of = tables.save(members.groupBy("comp").agg(F.sum(F.col("size") * 8).alias("bytes")), "component-sizes")
    comps = tables.save(members.join(small(bytes_of), "comp").select("comp", "bytes", "node", "lead", "th", "copies"), "components")
    tables.drop("edges", "members", "in-components")

    source = docs.select(F.col(f"`{key}`").cast("long").alias("lead"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    wanted = small(comps.withColumnsRenamed({"lead": "want", "th": "want_th"}))
    texts = source.join(wanted, (F.col("th") == F.col("want_th")) & F.col("lead").eqNullSafe(F.col("want"))).select("comp", "bytes", "node", "copies", "text")
    sets = as_sets(texts)
    one_block = dealt(sets.where(F.col("bytes") <= SET_BYTES), "comp", "node", F.lit(1)).select("comp", "i", "j", "n", "side", "node", "copies", "set")
    checked = tables.save(verify(one_block), "checked")
    links, roots = checked.select("node", "links"), checked.select("node", "root")
    if bytes_of.where(F.col("bytes") > SET_BYTES).count():
        left, near = counted_links(sets.where(F.col("bytes") > SET_BYTES), tables)
        near = tables.save(near, "near")
        far = tables.save(verify(left), "far")
        links = links.unionByName(near.select("node", "links")).unionByName(far.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
        # near sets are of their hub's class: only hubs and the other sets need to be joined up
        hub_of = near.select(F.col("node").alias("own"), "hub")
        ends = far.where("node != root").select(*[F.col(c).alias(c) for c in ("node", "root")])
        for c in ("node", "root"):
            ends = ends.join(hub_of, F.col(c) == F.col("own"), "left").withColumn(c, F.coalesce("hub", c)).drop("own", "hub")
        edges = tables.save(ends.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "far-edges")
        near_roots = near.select("node", F.col("hub").alias("root"))
        if edges.count():
            joined = components(tables, edges, "verified")
            of = joined.withColumnsRenamed({"node": "hub", "root": "whole"})
            near_roots = near.join(of, "hub", "left").select("node", F.coalesce("whole", "hub").alias("root"))
            roots = roots.unionByName(joined.join(near.select("node"), "node", "left_anti"))
        roots = roots.unionByName(near_roots)
    info = nodes.select("node", "lead", "th", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return tables, sketches, info


def leaders(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per class of documents with words: doc_id and th (xxhash64 of the text) of its first one,
    by id and then by th; a null id comes last."""
    _, _, info = verified_classes(docs, key, text)
    first = F.min(F.struct(F.col("lead").isNull(), "lead", "th"))
    return info.groupBy("root").agg(first.alias("l")).select(F.col("l.lead").alias("doc_id"), F.col("l.th").alias("th"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id, n_links (other documents at 0.8 or more), n_copies
    (documents with the same shingle set, itself included; 0 without words)."""
    tables, sketches, info = verified_classes(docs, key, text)
    info = tables.save(info, "links")
    # classes of one set need no join; a large class's rows meet its id without being dealt by it, or can be split
    classes = tables.save(info.groupBy("root").agg(F.min("lead").alias("class_id"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("root", "class_id"), "class-ids")
    found = info.join(small(classes), "root", "left").withColumn("class_id", F.when(F.col("class_id").isNull(), F.col("lead")).otherwise(F.col("class_id")))
    per_node = tables.save(found.select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")), "classes")
    out = sketches.select("doc_id", "node").join(per_node, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
