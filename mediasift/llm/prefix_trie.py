"""The trie of conversations by their first turns, with counts of subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns (role, text); the root has none. A node is named by its depth and its smallest
member, which no other node of that depth has. Nodes are found by hashes of prefixes: two sums of 50 bits over the turns' places
and SHA-256 digests, so a prefix's hash is a running sum and long conversations are cut into blocks. Texts are
read once and never shuffled.

The tour has an arc that enters and one that leaves each node. A sort by parent and child, dealt by ranges, gives each arc its
successor: the first child, the next sibling, or the way out of the parent. The tour is list-ranked: each task first joins up the chains among its
own arcs (arcs of a conversation are neighbours), then rounds of random mating halve what is left, about, by a join each, until a task can rank
``ONE_TASK`` chains; the way back adds up what was joined. Prefix sums at a node's two arcs differ by the sum over its
subtree. No conversation, node, group of siblings or list is ever gathered in a task: blocks, ranges and the chains' parts bound
them. Written tables between the steps make lost tasks repeat their own part only.

Turns go in the order of ``turn``, null first; those with equal ``turn`` go by the SHA-256 of the role's length in bytes, a
colon, the role and the text. Equal rows are turns of their own. Null role or text is empty. Rows without a conversation's id
take no part. An empty table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasift.llm.shared import Tables

#: Turns of a block; bits of a hash (sums over a block fit in a long); arcs that a task joins up at once; chains that one task ranks; arcs of a chain
#: that a rank is joined to at once; ids of a piece that is hashed.
SPAN, BITS, BLOCK_ARCS, ONE_TASK, CHAIN_PART, PIECE_IDS = 4096, 50, 1 << 19, 20_000, 1 << 16, 50_000
ARC, NEXT, WEIGHTS = ["conv_id", "depth", "side"], ["n_conv", "n_depth", "n_side"], ["arcs", "leaves", "saved"]
ENTER, LEAVE = 0, 1
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the one before; the first does."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def numbered(tables: Tables, conversations: DataFrame) -> DataFrame:
    """conv_id, lo, hi, turn_hash, n_bytes: equal turns that follow each other, and the places (from 1) that they take.

    Rows are dealt by ranges of (conv_id, turn, digest); a conversation over several ranges is carried on from one to the next."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(F.col("role"), F.col("text")).alias("turn_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    keys = ["conv_id", F.asc_nulls_first("turn"), "turn_hash"]
    once = turns.groupBy("conv_id", "turn", "turn_hash", "n_bytes").count()  # equal rows cannot be dealt apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            ends = np.cumsum(n)
            first = np.flatnonzero(changes([conv]))
            before = np.repeat((ends - n)[first] - np.where(conv[first] == last, total, 0), np.diff([*first, len(conv)]))
            done = ends - before
            last, total = conv[-1], int(done[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done - n), pa.array(np.full(len(conv), block, np.int32))], names=["conv_id", "turn_hash", "n_bytes", "n", "before", "block"])

    ordered = once.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn_hash", "n_bytes", "count")
    scanned = tables.save(ordered.mapInArrow(run, "conv_id long, turn_hash binary, n_bytes long, n long, before long, block int"), "scanned")
    # a row a range: what its first conversation has in the ranges before
    ends = scanned.groupBy("block").agg(F.min("conv_id").alias("conv_id"), F.max(F.struct("conv_id", (F.col("before") + F.col("n")).alias("n"))).alias("last"))
    ends = ends.withColumn("so_far", F.sum("last.n").over(W.partitionBy("last.conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)))
    place = W.orderBy("block")
    ends = ends.withColumn("carry", F.when(F.lag("last.conv_id").over(place) == F.col("conv_id"), F.lag("so_far").over(place)))
    carried = scanned.join(F.broadcast(ends.where("carry is not null").select("block", "conv_id", "carry")), ["block", "conv_id"], "left")
    start = F.coalesce("carry", F.lit(0)) + F.col("before")
    return carried.select("conv_id", (start + 1).alias("lo"), (start + F.col("n")).alias("hi"), "turn_hash", "n_bytes")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with ``lo`` and ``hi`` cut at the ends of blocks, with their block."""
    block = F.sequence(F.expr(f"(lo - 1) div {SPAN}"), F.expr(f"(hi - 1) div {SPAN}"))
    out = rows.withColumn("block", F.explode(block))
    return out.withColumn("lo", F.greatest("lo", F.col("block") * SPAN + 1)).withColumn("hi", F.least("hi", (F.col("block") + 1) * SPAN))


def plain(tables: Tables, rows: DataFrame) -> DataFrame:
    """Conversations as they are: conv_id, n_own (turns), skip, base, taken (turns of the base)."""
    return rows.groupBy("conv_id").agg(F.max("hi").alias("n_own")).select("conv_id", "n_own", F.lit(0).cast("long").alias("skip"), F.lit(None).cast("long").alias("base"), F.lit(0).cast("long").alias("taken"))


def grafted(tables: Tables, rows: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations whose first h turns are those of the conversation ``conv_id - conv_id % group``; h is crc32(conv_id) % most."""
    sizes = tables.save(rows.groupBy("conv_id").agg(F.max("hi").alias("n_own")), "sizes")
    own = sizes.select("*", F.expr(f"conv_id - conv_id % {group}").alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("skip"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    found = own.where("base != conv_id").join(bases, "base", "left").select("conv_id", "n_own", "skip", "base", F.least("skip", F.coalesce("n_base", F.lit(0))).alias("taken"))
    nothing = F.lit(0).cast("long")
    return found.unionByName(own.where("base = conv_id").select("conv_id", "n_own", nothing.alias("skip"), F.lit(None).cast("long").alias("base"), nothing.alias("taken")))


def built(tables: Tables, rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """conv_id, depth, turn_hash, n_bytes, total: the turns of every conversation with a turn, by ``plan`` (at most ``most`` turns of a base)."""
    cut = in_blocks(rows)
    # a row of the plan for each block of a conversation, so that no key has more rows than a block
    spread = plan.withColumn("total", F.col("taken") + F.greatest(F.col("n_own") - F.col("skip"), F.lit(0)))
    by_block = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(n_own - 1) div {SPAN}"))))
    own = cut.join(by_block.select("conv_id", "block", "skip", "taken", "total"), ["conv_id", "block"]).withColumn("lo", F.greatest("lo", F.col("skip") + 1)).where("lo <= hi")
    own = own.select("conv_id", F.explode(F.sequence("lo", "hi")).alias("at"), "turn_hash", "n_bytes", "skip", "taken", "total")
    own = own.select("conv_id", (F.col("at") - F.col("skip") + F.col("taken")).alias("depth"), "turn_hash", "n_bytes", "total")
    if not most:
        return own
    heads = rows.where(F.col("lo") <= most).withColumn("depth", F.explode(F.sequence("lo", F.least("hi", F.lit(most).cast("long"))))).select(F.col("conv_id").alias("base"), "depth", "turn_hash", "n_bytes")
    lent = spread.where("taken > 0").select("conv_id", "base", "taken", "total").join(heads, "base").where("depth <= taken")
    return own.unionByName(lent.select("conv_id", "depth", "turn_hash", "n_bytes", "total"))


def hashed(tables: Tables, turns: DataFrame) -> DataFrame:
    """Turns with the hashes of the prefix that ends with them (h1, h2) and of the one before (p1, p2)."""
    mask = (1 << BITS) - 1
    rows = turns.withColumn("block", F.expr(f"(depth - 1) div {SPAN}"))
    for k in (1, 2):
        rows = rows.withColumn(f"g{k}", F.xxhash64(F.lit(k), "depth", "turn_hash").bitwiseAND(F.lit(mask)))
    order = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "block", "depth", "n_bytes", "total", "g1", "g2", F.sum("g1").over(order).alias("h1"), F.sum("g2").over(order).alias("h2"))
    rows = tables.save(rows, "sums")
    long = rows.where(F.col("total") > SPAN).groupBy("conv_id", "block").agg(*[F.max(f"h{k}").cast("decimal(20, 0)").alias(f"s{k}") for k in (1, 2)])
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = long.select("conv_id", "block", *[(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)) % (1 << BITS)).cast("long").alias(f"s{k}") for k in (1, 2)])
    later = rows.where("block > 0").join(sums, ["conv_id", "block"]).withColumns({f"h{k}": F.col(f"h{k}") % (1 << BITS) + F.col(f"s{k}") for k in (1, 2)}).drop("s1", "s2")
    both = rows.where("block = 0").unionByName(later)
    both = both.withColumns({f"h{k}": F.col(f"h{k}").bitwiseAND(F.lit(mask)) for k in (1, 2)})
    return both.select("conv_id", "depth", "n_bytes", (F.col("depth") == F.col("total")).alias("ends"), "h1", "h2", *[(F.col(f"h{k}") - F.col(f"g{k}")).bitwiseAND(F.lit(mask)).alias(f"p{k}") for k in (1, 2)])


def end_hashes(tables: Tables, ends: DataFrame) -> DataFrame:
    """depth, h1, h2, sha: SHA-256 of the ids of the conversations that end at a node, ascending, with commas.

    Tasks write the ids of their ranges out in pieces; a node's pieces are then hashed one after the other, none held."""
    key = ["depth", "h1", "h2"]

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            starts = np.flatnonzero(changes(columns[:3]))
            starts = np.unique(np.concatenate([starts, np.arange(0, batch.num_rows, PIECE_IDS)]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows).astype(np.int32)), batch.column(3).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in columns], pc.binary_join(lists, ",")], names=[*key, "first", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for *k, ids in zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 4)], strict=True):
                if k == now:
                    state.update(b",")
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                state.update(ids.encode())
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if now:
            out.append((*now, state.hexdigest()))
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*key, "sha"])

    pieces = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(write_out, "depth long, h1 long, h2 long, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(finish, "depth long, h1 long, h2 long, sha string")


FAMILY = "block int, first boolean, last boolean, child boolean, conv_id long, depth long, n_convs long, n_bytes long, next_child boolean, next_conv long, parent long, last_parent long"


def families(tables: Tables, nodes: DataFrame) -> DataFrame:
    """Every node twice: as a parent (child false) with its first child, and as a child with its next sibling and its parent.

    Rows are sorted by the parent's hash, the parent first and its children by id, dealt by ranges; what a range needs of its
    neighbours (its next row, and the last parent before it) comes from a row for each range."""
    none = F.lit(None).cast("long")
    parents = nodes.select(F.col("depth").alias("k0"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(False).alias("child"), "conv_id", "depth", "n_convs", "n_bytes")
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("k0"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(True).alias("child"), "conv_id", "depth", none.alias("n_convs"), none.alias("n_bytes"))
    keys = ["k0", "k1", "k2", "child", "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parent, held, begun = TaskContext.get().partitionId(), None, None, False
        names = [x.split()[0] for x in FAMILY.split(", ")]

        def out(rows: pa.Table, follow: pa.Table | None) -> pa.RecordBatch:
            """Rows with their next ones; the last row of the range has none."""
            nonlocal parent, begun
            n = rows.num_rows
            child, conv = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            after = pa.concat_tables([rows.slice(1), follow] if follow is not None else [rows.slice(1)])
            at = np.maximum.accumulate(np.where(child, -1, np.arange(n)))
            own = pa.array(np.where(at >= 0, conv[at], parent if parent is not None else 0), mask=(at < 0) & (parent is None))
            parent = own[-1].as_py()
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            first[0], last[-1], begun = not begun, follow is None, True
            pad = n - after.num_rows
            nexts = [pa.concat_arrays([after.column(c).combine_chunks(), pa.nulls(pad, after.schema.types[c])]) for c in (0, 1)]
            columns = [c.combine_chunks() for c in rows.columns]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(first), pa.array(last), *columns, *nexts, own, pc.if_else(pa.array(last), own, pa.scalar(None, pa.int64()))], names=names)

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                if held is not None:
                    yield out(held, table.slice(0, 1))
                held = table
        if held is not None:
            yield out(held, None)

    ordered = parents.unionByName(children).repartitionByRange(*keys).sortWithinPartitions(*keys).select("child", "conv_id", "depth", "n_convs", "n_bytes")
    scanned = tables.save(ordered.mapInArrow(run, FAMILY), "families")
    place = W.orderBy("block")
    edges = scanned.where("first").select("block", F.col("child").alias("f_child"), F.col("conv_id").alias("f_conv")).join(scanned.where("last").select("block", "last_parent"), "block")
    edges = edges.select("block", F.lead("f_child").over(place).alias("e_child"), F.lead("f_conv").over(place).alias("e_conv"), F.last("last_parent", True).over(place.rowsBetween(W.unboundedPreceding, -1)).alias("e_parent"))
    fixed = scanned.join(F.broadcast(edges), "block")
    follows = F.coalesce(F.when(F.col("last"), F.col("e_child")).otherwise(F.col("next_child")), F.lit(False))
    return fixed.select("child", "conv_id", "depth", "n_convs", "n_bytes", F.coalesce("parent", "e_parent").alias("parent"), F.when(follows, F.when(F.col("last"), F.col("e_conv")).otherwise(F.col("next_conv"))).alias("follow"))


def tour(rows: DataFrame) -> DataFrame:
    """The arcs with their successors and weights; ``info`` is the node's members (enter) or its parent (leave)."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    some = F.col("follow").isNotNull()
    enter = rows.where("not child").select(
        "conv_id", "depth", F.lit(ENTER).alias("side"), F.coalesce("follow", "conv_id").alias("n_conv"), F.when(some, F.col("depth") + 1).otherwise(F.col("depth")).alias("n_depth"), F.when(some, ENTER).otherwise(LEAVE).alias("n_side"),
        F.when(some, 0).otherwise(1).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.col("n_convs").alias("info"),
    )
    leave = rows.where("child").select(
        "conv_id", "depth", F.lit(LEAVE).alias("side"), F.coalesce("follow", "parent").alias("n_conv"), F.when(some, F.col("depth")).otherwise(F.col("depth") - 1).alias("n_depth"), F.when(some, ENTER).otherwise(LEAVE).alias("n_side"),
        zero.alias("leaves"), zero.alias("saved"), F.col("parent").alias("info"),
    )
    root = rows.where("not child and depth = 0").select("conv_id", "depth", F.lit(LEAVE).alias("side"), none.alias("n_conv"), none.alias("n_depth"), F.lit(None).cast("int").alias("n_side"), zero.alias("leaves"), zero.alias("saved"), none.alias("info"))
    return enter.unionByName(leave).unionByName(root)


def places(ids: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Where each wanted row of numbers is among the ids, or -1."""
    columns = [np.concatenate(pair) for pair in zip(ids, wanted, strict=True)]
    order = np.lexsort(columns[::-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(changes([c[order] for c in columns]))
    at, n = np.full(len(order) + 1, -1), len(ids[0])
    at[group[:n]] = np.arange(n)
    return at[group[n:]]


def chains(follow: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By pointer jumping over lists without cycles: each element's head, the sum of weights before it, and each one's tail (of heads only)."""
    n = len(follow)
    back = np.full(n, -1)
    some = np.flatnonzero(follow >= 0)
    back[follow[some]] = some
    head, before = np.arange(n), np.zeros_like(weights)
    has = back >= 0
    before[has] = weights[back[has]]
    head[has] = back[has]
    jump = back
    while (go := np.flatnonzero(jump >= 0)).size:
        # a step to where the element before jumped: its head and its sum so far
        before[go] += before[jump[go]]
        head[go] = head[jump[go]]
        new = jump.copy()
        new[go] = jump[jump[go]]
        jump = new
    tail = np.full(n, -1)
    ends = np.flatnonzero(follow < 0)
    tail[head[ends]] = ends
    return head, before, tail


def joined_up(arcs: DataFrame) -> DataFrame:
    """Arcs with the head of their chain among the arcs of a block, and the weights before them; heads also have the chain's successor and weights."""
    names = [*ARC, "head_conv", "head_depth", "head_side", *[f"before_{w}" for w in WEIGHTS], "info", "is_head", *NEXT, *WEIGHTS]
    kinds = ["long", "long", "int"] * 2 + ["long"] * 4 + ["boolean"] + ["long", "long", "int"] + ["long"] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ARCS:
                yield solve(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield solve(pa.Table.from_batches(held))

    def solve(t: pa.Table) -> pa.RecordBatch:
        ids = [t.column(c).to_numpy() for c in ARC]
        none = t.column("n_conv").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        nexts = [t.column(c).combine_chunks().fill_null(0).to_numpy() for c in NEXT]
        follow = np.where(none, -1, places(ids, nexts))
        weights = np.stack([np.ones(len(none), np.int64), t.column("leaves").to_numpy(), t.column("saved").to_numpy()], axis=1)
        head, before, tail = chains(follow, weights)
        is_head = head == np.arange(len(head))
        end = np.where(is_head, tail, 0)
        total = before[end] + weights[end]
        after = [pa.array(c[end], mask=none[end] | ~is_head) for c in nexts]
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in ids], *[pa.array(c[head]) for c in ids], *[pa.array(c) for c in before.T], t.column("info").combine_chunks(), pa.array(is_head), *after, *[pa.array(c, mask=~is_head) for c in total.T]], names=names)

    return arcs.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def ranked(tables: Tables, lists: DataFrame) -> DataFrame:
    """The chains (ARC, NEXT, WEIGHTS) of one list with the weights before them, by random mating.

    In a round every chain draws by a hash of its id and the round; one that draws 1 after one that draws 0 is joined to it. A quarter of the
    chains goes each round, so all rounds together cost a few times the first."""
    undo, k = [], 0
    while lists.count() > ONE_TASK:
        coin = lambda names, k=k: F.xxhash64(F.lit(k), *names).bitwiseAND(F.lit(1))
        now = lists.withColumn("own", coin(ARC)).withColumn("next", F.when(F.col("n_conv").isNotNull(), coin(NEXT)).otherwise(0))
        takes = now.where("own = 0 and next = 1").select(*[F.col(c).alias(f"t_{c}") for c in (*ARC, *WEIGHTS)], *[F.col(c).alias(a) for c, a in zip(NEXT, ARC, strict=True)])
        met = tables.save(now.where("own = 1").drop("own", "next").join(takes, ARC, "left"), f"met-{k}")
        taken = met.where("t_conv_id is not null")
        merged = taken.select(*[F.col(f"t_{c}").alias(c) for c in ARC], *NEXT, *[(F.col(f"t_{w}") + F.col(w)).alias(w) for w in WEIGHTS])
        rest = now.where("own = 0 and next = 0").select(*ARC, *NEXT, *WEIGHTS)
        lists = tables.save(rest.unionByName(merged).unionByName(met.where("t_conv_id is null").select(*ARC, *NEXT, *WEIGHTS)), f"chains-{k}")
        undo.append(taken.select(*ARC, *[f"t_{c}" for c in (*ARC, *WEIGHTS)]))
        k += 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, none = [t.column(c).to_numpy() for c in ARC], t.column("n_conv").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        follow = np.where(none, -1, places(ids, [t.column(c).combine_chunks().fill_null(0).to_numpy() for c in NEXT]))
        _, before, _ = chains(follow, np.stack([t.column(w).to_numpy() for w in WEIGHTS], axis=1))
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in ids], *[pa.array(c) for c in before.T]], names=[*ARC, *[f"at_{w}" for w in WEIGHTS]])

    schema = "conv_id long, depth long, side int, at_arcs long, at_leaves long, at_saved long"
    found = tables.save(lists.repartition(1).mapInArrow(solve, schema), "ranks")
    for i, taken in reversed(list(enumerate(undo))):
        before = found.select(*[F.col(c).alias(f"t_{c}") for c in ARC], *[f"at_{w}" for w in WEIGHTS])
        back = taken.join(before, [f"t_{c}" for c in ARC]).select(*ARC, *[(F.col(f"at_{w}") + F.col(f"t_{w}")).alias(f"at_{w}") for w in WEIGHTS])
        found = tables.save(found.unionByName(back), f"ranks-{i}")
    return found


def prefix_trie(conversations: DataFrame, plan=plain, most: int = 0) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at, leave_at.

    ``plan`` says which turns make up a conversation (``plain``: its own; ``grafted``: the first ones of another, at most ``most``)."""
    tables = Tables(conversations.sparkSession, "trie")
    rows = tables.save(numbered(tables, conversations), "numbered")
    whole = tables.save(plan(tables, rows), "plan")
    turns = tables.save(hashed(tables, built(tables, rows, whole, most)), "turns")
    key, zero = ["depth", "h1", "h2"], F.lit(0).cast("long")
    nodes = turns.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = whole.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = tables.save(nodes.unionByName(root.select(*[zero.alias(c) for c in key], "conv_id", "n_convs", zero.alias("n_bytes"), zero.alias("p1"), zero.alias("p2"))), "nodes")
    ends = turns.where("ends").select(*key, "conv_id").unionByName(whole.where("taken = 0 and n_own <= skip").select(*[zero.alias(c) for c in key], "conv_id"))
    shas = nodes.select(*key, "conv_id").join(end_hashes(tables, ends), key).select("conv_id", "depth", "sha")

    arcs = tables.save(tour(families(tables, nodes)), "tour")
    joined = tables.save(joined_up(arcs.repartitionByRange("conv_id", "depth")), "joined")
    ranks = ranked(tables, joined.where("is_head").select(*ARC, *NEXT, *WEIGHTS))
    # a long chain's rank is joined to its arcs in parts
    lengths = joined.where("is_head").select(*ARC, F.explode(F.sequence(F.lit(0), F.expr(f"(arcs - 1) div {CHAIN_PART}").cast("int"))).alias("part"))
    heads = ["head_conv", "head_depth", "head_side"]
    by_part = ranks.join(lengths, ARC).select(*[F.col(a).alias(h) for a, h in zip(ARC, heads, strict=True)], "part", *[f"at_{w}" for w in WEIGHTS])
    placed = joined.withColumn("part", F.expr(f"before_arcs div {CHAIN_PART}").cast("int")).join(by_part, [*heads, "part"])
    placed = placed.select(*ARC, "info", *[(F.col(f"before_{w}") + F.col(f"at_{w}")).alias(w) for w in WEIGHTS])

    sign, enters = F.when(F.col("side") == ENTER, -1).otherwise(1), F.col("side") == ENTER
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    sums = placed.select("conv_id", "depth", (sign * F.col("leaves")).alias("leaves"), (sign * F.col("saved")).alias("saved"), F.when(enters, F.col("info")).alias("n_convs"), F.when(~enters, F.col("info")).alias("parent"), F.when(enters, F.col("arcs")).alias("enter_at"), F.when(~enters, F.col("arcs")).alias("leave_at"), zero.alias("child"), text.alias("sha"))
    child = arcs.where(f"side = {LEAVE} and info is not null").select(F.col("info").alias("conv_id"), (F.col("depth") - 1).alias("depth"), zero.alias("leaves"), zero.alias("saved"), *[none.alias(c) for c in ("n_convs", "parent", "enter_at", "leave_at")], F.lit(1).cast("long").alias("child"), text.alias("sha"))
    sha = shas.select("conv_id", "depth", zero.alias("leaves"), zero.alias("saved"), *[none.alias(c) for c in ("n_convs", "parent", "enter_at", "leave_at")], zero.alias("child"), "sha")
    out = sums.unionByName(child).unionByName(sha).groupBy("conv_id", "depth")
    return out.agg(
        F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("sha"), F.lit(NOTHING)).alias("ends_sha256"), F.max("enter_at").alias("enter_at"), F.max("leave_at").alias("leave_at"),
    )
