"""Scoring texts with an n-gram language model in Elias-Fano tries.

Training counts words, then three-word sequences, of all training documents with Spark: tasks count
what they read, write sorted and compressed runs, and shuffle those by the first word. Words that
hold much of the corpus are dealt by first and second word, so that no shard is hot. Each shard is
a trie of three levels. The word ids of a level are one Elias-Fano sequence, in which each context's range goes
on where the one before ended; the pointers to the ranges are another. A node is found by a successor search
relative to its context, between the context's two pointers. Nodes carry their discounted probability, and inner nodes the weight left to shorter
contexts, quantised to 16 bits on a logarithmic scale. Shards are files that tasks map into memory,
so the model may be larger than any heap. Scoring deals the distinct triples of blocks of text to the shards and
the answers back to the blocks, so a task opens its own shards only. The vocabulary is opened by every task.

The model interpolates with absolute discounting:
``p(c|ab) = max(n(abc) - D, 0) / n(ab.) + D * n1(ab.) / n(ab.) * p(c|b)``, likewise for ``p(c|b)``, and
``p(c) = (n(c) + 0.5) / (N + 0.5 * (V + 1))``; it sums to one over the V known words and one unknown.

A-Z are lower-cased; tokens are runs of bytes other than space and 0x09-0x0D, then an end token. A
null or empty text is the end token alone; texts of any length are scored whole. Keys are passed on, so null and
repeated ones are like others. Repeated rows train and score as often as they occur. An
empty training set gives every token the unknown word's share. Only key and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm import level_files
from mediasift.llm.arrow_text import Words, blocks, mix
from mediasift.llm.elias_fano import EliasFano
from mediasift.llm.jaccard import groups
from mediasift.llm.shared import Tables, shared_dir

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
END = np.uint64(0xE0D0E0D0E0D0E0D1)
SCALE, NONE = 2000.0, 65535
COUNT_TOKENS = 1_500_000
#: Tokens of a block that is scored.
SCORE_TOKENS = 500_000
#: Word ids from here on are renumbered before two of them are put into 64 bits.
WIDE = 1 << 32


def quantise(p: np.ndarray) -> np.ndarray:
    """16 bits for a number in (0, 1], in steps of 0.12 %; 65535 is zero."""
    with np.errstate(divide="ignore"):
        q = np.rint(-np.log10(np.minimum(p, 1.0)) * SCALE)
    return np.where(p > 0, np.minimum(q, NONE - 1), NONE).astype(np.uint16)


_VALUE = np.append(10.0 ** (-np.arange(NONE) / SCALE), 0.0)


def token_hashes(block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's tokens, the end included, and where each document's begin."""
    words = Words(block, data=LOWER[block.data])
    rows = len(block)
    out = np.full(len(words.hashes) + rows, END, np.uint64)
    out[np.arange(len(words.hashes)) + words.row] = words.hashes
    return out, words.first + np.arange(rows + 1)


def count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                held.append(token_hashes(block)[0])
                size += len(held[-1])
                if size > 2 * COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Sorted hashes and counts of words, in mapped files dealt by the hash's leading bits.

    A word's id is its file's number plus the number of files times its rank by count in the file, so frequent words
    have small ids. All ids are below ``start``, the id of the start."""

    def __init__(self, root: str, files: list[str], bits: int):
        self.bits = bits
        self.parts = [level_files.read(root, f)[0] if f else None for f in files]
        sizes = [len(p["w"]) if p else 0 for p in self.parts]
        self.start = len(files) * max(sizes, default=0)

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of sorted hashes."""
        ids, n = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(len(self.parts) + 1))
        for k, p in enumerate(self.parts):
            a, b = cuts[k], cuts[k + 1]
            if p is None or a == b:
                continue
            at = np.minimum(np.searchsorted(p["w"], hashes[a:b]), len(p["w"]) - 1)
            hit = p["w"][at] == hashes[a:b]
            ids[a:b] = np.where(hit, p["rank"][at].astype(np.int64) * len(self.parts) + k, -1)
            n[a:b] = np.where(hit, p["n"][at], 0)
        return ids, n


def _writer(root: str, build):
    """A map over rows sorted by ``shard`` that writes a file for each shard and lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for g in groups(batches, ["shard"]):
            shard = g.column("shard")[0].as_py()
            name = f"{build.__name__}-{shard:06d}-{attempt}"
            arrays, meta, extra = build(g)
            level_files.write(root, name, arrays, meta)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), pa.array([extra], pa.binary())], names=["shard", "file", "extra"])

    return run


def vocabulary(g: pa.Table):
    w, n = g.column("w").to_numpy().view(np.uint64), g.column("n").to_numpy()
    order = np.argsort(w)
    w, n = w[order], n[order]
    rank = np.empty(len(w), np.uint32)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(w), dtype=np.uint32)
    return {"w": w, "n": n, "rank": rank}, {}, b""


def shard_of(a: np.ndarray, b: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the first word, or by both where the first is a hot one."""
    key = a.astype(np.uint64)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
        key = np.where(is_hot, key * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(1), key)
    return (mix(key) % np.uint64(shards)).astype(np.int64)


def narrow(shard: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of shards in 16 bits if they fit, which numpy sorts by their digits."""
    return shard.astype(np.int16) if shards <= 1 << 15 else shard


def pack_run(*columns: np.ndarray) -> bytes:
    """Equally long columns of numbers, as planes of bytes (four a number, or eight if one needs them), compressed."""
    width = 8 if any(len(c) and int(c.max()) >> 32 for c in columns) else 4
    planes = [np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([bytes([width]), *planes]))


def unpack_run(raw: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    width = raw[0]
    data = np.frombuffer(raw, np.uint8, offset=1).reshape(columns, width, -1)
    return [np.ascontiguousarray(p.T).view(f"<u{width}").ravel() for p in data]


def steps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as differences: of a, and of b while a stays the same."""
    da, db = np.diff(a, prepend=0), b.copy()
    same = np.flatnonzero(da[1:] == 0) + 1
    db[same] -= b[same - 1]
    return da, db


def unsteps(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    da, total = da.astype(np.int64), np.cumsum(db.astype(np.int64))
    new = da > 0
    new[:1] = True
    first = np.flatnonzero(new)
    return np.cumsum(da), total - np.repeat(total[first] - db[first].astype(np.int64), np.diff(np.append(first, len(da))))


def unique_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray | None = None):
    """Distinct (a, b, c) in order, with summed counts."""
    if len(a) and max(int(x.max()) for x in (a, b, c)) >= WIDE:
        names, code = np.unique(np.concatenate([a, b, c]), return_inverse=True)  # far fewer than 2**32 in one shard
        a, b, c, n = unique_triples(*np.split(code, 3), n)
        return names[a].astype(np.int64), names[b].astype(np.int64), names[c].astype(np.int64), n
    pair, code = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)
    key = (code.astype(np.uint64) << np.uint64(32)) | c.astype(np.uint64)
    if n is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
    pair = pair[(key >> np.uint64(32)).astype(np.int64)]
    return (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), n


def make_trie(start: int, hot: np.ndarray, hot_counts: np.ndarray, discount: float):
    """A builder of one shard's trie; ``start`` is the id of the start and ``start + 1`` of the padding."""
    universe = start + 2  # of first words

    def trie(g: pa.Table):
        runs = [unpack_run(raw, 4) for raw in g.column("run").to_pylist()]
        cols = [np.concatenate(x) for x in zip(*[(*unsteps(*r[:2]), *r[2:]) for r in runs], strict=True)]
        a, b, c, n = unique_triples(*cols)
        new2 = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        at2 = np.flatnonzero(new2)
        n2 = np.add.reduceat(n, at2)
        a2, b2, parent = a[at2], b[at2], np.cumsum(new2) - 1
        real = c != start + 1  # the padding counts for its pair only
        parent, c, n = parent[real], c[real], n[real]
        total = np.bincount(parent, n, len(at2))
        kinds = np.bincount(parent, minlength=len(at2))
        new1 = np.append(True, a2[1:] != a2[:-1])
        at1 = np.flatnonzero(new1)
        a1, root = a2[at1], np.cumsum(new1) - 1
        followed = b2 != start  # a start after a start is a context, not an event
        n1 = np.bincount(root[followed], n2[followed], len(at1))
        kinds1 = np.bincount(root[followed], minlength=len(at1))
        is_hot = np.isin(a1, hot)
        whole = n1.copy()
        whole[is_hot] = hot_counts[np.searchsorted(hot, a1[is_hot])]
        parts = {
            "roots": EliasFano.build(a1, universe), "children1": EliasFano.build(np.append(at1, len(at2)), len(at2) + 1),
            "nodes2": EliasFano.ranges(b2, np.append(at1, len(at2))),
            "children2": EliasFano.build(np.concatenate([[0], np.cumsum(kinds)]), len(c) + 1),
            "nodes3": EliasFano.ranges(c, np.concatenate([[0], np.cumsum(kinds)])),
        }
        arrays = {f"{k}.{x}": v for k, ef in parts.items() for x, v in ef.arrays().items()}
        arrays["rest1"] = quantise(np.where(whole > 0, discount * kinds1 / np.maximum(whole, 1), 1.0))
        arrays["p2"] = quantise(np.maximum(n2 - discount, 0) / np.maximum(whole[root], 1))
        arrays["rest2"] = quantise(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0))
        arrays["p3"] = quantise(np.maximum(n - discount, 0) / np.maximum(total[parent], 1))
        extra = pack_run(np.searchsorted(hot, a1[is_hot]), kinds1[is_hot])
        return arrays, {"parts": {k: [ef.n, ef.width] for k, ef in parts.items()}}, extra

    return trie


class Trie:
    """A shard's levels, mapped."""

    def __init__(self, root: str, name: str):
        arrays, meta = level_files.read(root, name)
        for k, (n, width) in meta["parts"].items():
            setattr(self, k, EliasFano(n, width, *(arrays[f"{k}.{x}"] for x in ("low", "high", "zeros", "ones"))))
        self.rest1, self.p2, self.rest2, self.p3 = (arrays[k] for k in ("rest1", "p2", "rest2", "p3"))

    @staticmethod
    def children(pointers: EliasFano, nodes: EliasFano, parent: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of words among the children of sorted parents, -1 where they are none."""
        new = np.ones(len(parent), bool)
        new[1:] = parent[1:] != parent[:-1]
        own = parent[new]
        ends = pointers.get(np.concatenate([own, own + 1])).astype(np.int64)
        at = np.cumsum(new) - 1
        begin, end = ends[: len(own)], ends[len(own) :]
        return nodes.find_in(words, begin[at], end[at], nodes.base(begin)[at])


class Model:
    """What scoring needs: files of the vocabulary, a table (shard, file) of the tries, a few numbers and the hot words."""

    def __init__(self, root: str, vocabulary: list[str], bits: int, tries: DataFrame | None, shards: int, start: int, words: int, tokens: int, hot: np.ndarray, hot_rest: np.ndarray):
        self.root, self.vocabulary, self.bits, self.tries, self.shards, self.start = root, vocabulary, bits, tries, shards, start
        self.words, self.tokens, self.hot, self.hot_rest = words, tokens, hot, hot_rest

    def close(self) -> None:
        """Remove the tries and the vocabulary; scores that ``score_texts`` has returned do not read them."""
        if self.tries is not None:
            path = self.tries.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.tries.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def numbers(self) -> Model:
        """Without the table, to be sent to tasks."""
        return Model(self.root, self.vocabulary, self.bits, None, self.shards, self.start, self.words, self.tokens, self.hot, self.hot_rest)


def sequences(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The documents' ids one after another, each with two starts before and one padding after it."""
    rows = len(first) - 1
    out = np.full(len(ids) + 3 * rows, start, np.int64)
    out[np.arange(len(ids)) + 3 * np.repeat(np.arange(rows), np.diff(first)) + 2] = ids
    out[first[1:] + 3 * np.arange(1, rows + 1) - 1] = start + 1
    return out


class Lookups:
    """The distinct triples of a block, by shard; all that is asked of the tries, in an order that depends on the block alone.

    ``names`` are the block's ids in order and ``code`` its sequences as places in them. A document of n tokens
    has n + 1 triples: the first two words of a token's next triple are the token's pair."""

    def __init__(self, names: np.ndarray, code: np.ndarray, m: Model):
        start, padding = np.searchsorted(names, [m.start, m.start + 1])
        a, b, c = code[:-2], code[1:-1], code[2:]
        real = (c != start) & (b != padding)
        self.token = np.flatnonzero(c[real] != padding)
        self.word = c[real][self.token]
        pairs, pair = np.unique(a[real] << 32 | b[real], return_inverse=True)
        triples, self.triple = np.unique(pair << 32 | c[real], return_inverse=True)
        self.pair_of = triples >> 32
        self.pair = pair
        self.a, self.b, self.c = names[pairs >> 32], names[pairs & 0xFFFFFFFF], names[triples & 0xFFFFFFFF]
        shard = np.where(self.a > m.start, -1, shard_of(self.a, self.b, m.hot, m.shards))  # an unknown first word is in no trie
        shard = narrow(shard, m.shards)
        self.pairs_by, self.triples_by = np.argsort(shard, kind="stable"), np.argsort(shard[self.pair_of], kind="stable")
        self.pair_shards, self.triple_shards = shard[self.pairs_by], shard[self.pair_of][self.triples_by]

    def shards(self) -> list[int]:
        found = np.unique(self.pair_shards)
        return found[found >= 0].tolist()

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a shard's pairs and triples."""
        a, b = np.searchsorted(self.pair_shards, [shard, shard + 1])
        c, d = np.searchsorted(self.triple_shards, [shard, shard + 1])
        return self.pairs_by[a:b], self.triples_by[c:d]


def train(docs: DataFrame, *, text: str = "text", discount: float = 0.75, shard_tokens: int = 2_000_000, vocabulary_bits: int = 6) -> Model:
    """Count all of ``docs`` and write the model under the shared folder."""
    spark = docs.sparkSession
    tables = Tables(spark, "lm")
    root = f"{shared_dir(spark)}/lm-model-{uuid.uuid4().hex}"
    source = docs.select(F.col(f"`{text}`").alias("text"))
    counts = tables.save(count_words(source), "words")
    words, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not words:
        return Model(root, [], vocabulary_bits, None, 1, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0))
    dealt = counts.withColumn("shard", F.shiftrightunsigned("w", 64 - vocabulary_bits))
    listed = tables.save(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_writer(root, vocabulary), "shard long, file string, extra binary"), "vocabulary")
    files: list[str | None] = [None] * (1 << vocabulary_bits)
    for r in listed.collect():  # at most 2**vocabulary_bits rows
        files[r["shard"]] = r["file"]
    shards = max(8, -(-tokens // shard_tokens))
    # at most 4 * shards words hold more than a quarter of a shard's tokens each
    heavy = {np.uint64(r["w"] % 2**64): r["n"] for r in counts.where((F.col("n") > tokens / (4 * shards)) & (F.col("w") != int(END.view(np.int64)))).collect()}
    look = Vocabulary(root, files, vocabulary_bits)
    tables.drop("words")
    hashes = np.sort(np.array(list(heavy), np.uint64))
    ends = int(look.look(np.array([END]))[1][0])
    start = look.start
    hot = np.append(look.look(hashes)[0], start)
    hot_counts = np.append([heavy[h] for h in hashes], ends)  # the start is followed once for each document
    order = np.argsort(hot)
    hot, hot_counts = hot[order].astype(np.int64), hot_counts[order].astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(root, files, vocabulary_bits)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            real = (c != start) & (b != start + 1)  # not from one document into the next
            a, b, c, n = unique_triples(a[real], b[real], c[real])
            shard = shard_of(a, b, hot, shards)
            by = np.argsort(narrow(shard, shards), kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            some = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
            own = [by[cuts[k] : cuts[k + 1]] for k in some]
            runs = [pack_run(*steps(a[x], b[x]), c[x], n[x]) for x in own]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(runs, pa.binary())], names=["shard", "run"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                h, first = token_hashes(block)
                distinct, back = np.unique(h, return_inverse=True)
                ids = vocabulary.look(distinct)[0][back]
                held.append(sequences(ids, first, start))
                size += len(held[-1])
                if size > COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    runs = source.mapInArrow(count, "shard long, run binary").repartition(shards, "shard").sortWithinPartitions("shard")
    built = tables.save(runs.mapInArrow(_writer(root, make_trie(start, hot, hot_counts, discount)), "shard long, file string, extra binary"), "tries")
    kinds = np.zeros(len(hot))
    for at, n in built.where("length(extra) > 0").mapInArrow(_hot_kinds, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a row a hot word
        kinds[at] = n
    return Model(root, files, vocabulary_bits, built.select("shard", "file"), shards, start, words, tokens, hot, np.where(hot_counts > 0, discount * kinds / np.maximum(hot_counts, 1), 1.0))


def _hot_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(2).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in unpack_run(raw, 2)], names=["at", "n"])


BLOCK = "block long, shard long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, data binary"


def coded(docs: DataFrame, m: Model) -> DataFrame:
    """Blocks of about ``SCORE_TOKENS`` tokens: keys, sizes, the distinct ids with their counts, and the sequences as places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(m.root, m.vocabulary, m.bits)
        unknown = m.start + 2
        block_id, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            keys, held_out, sizes, ids, n, rows = zip(*held, strict=True)
            names, code = np.unique(np.concatenate(rows), return_inverse=True)
            counts = np.zeros(len(names), np.int64)
            counts[np.searchsorted(names, np.concatenate(ids))] = np.concatenate(n)
            lists = [pa.concat_arrays(keys), pa.concat_arrays(held_out), pa.array(np.concatenate(sizes))]
            often = np.argsort(-np.bincount(code), kind="stable")  # frequent words get small numbers
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            cols = [pa.array([block_id]), pa.array([-1]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([pack_run(names[often], counts[often])], pa.binary()), pa.array([pack_run(place[code])], pa.binary())], names=["block", "shard", "doc_ids", "held", "sizes", "words", "data"])

        for batch in batches:
            for block in blocks(batch.column(2)):
                h, first = token_hashes(block)
                distinct, back = np.unique(h, return_inverse=True)
                ids, n = known.look(distinct)
                ids = np.where(ids < 0, unknown, ids)
                own = [batch.column(k).slice(block.lo, len(block)) for k in (0, 1)]
                held.append((*own, np.diff(first), ids, n, sequences(ids[back], first, m.start)))
                size += len(h)
                if size > SCORE_TOKENS:
                    yield flush()
                    block_id, held, size = block_id + 1, [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def unpack_block(words: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids in order, their counts, and its sequences as places in them."""
    names, counts = (x.astype(np.int64) for x in unpack_run(words, 2))
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], counts[order], place[unpack_run(data, 1)[0]]


def asked(block_rows: DataFrame, m: Model) -> DataFrame:
    """What the blocks ask of each shard: rows of shard, block, and the triples as a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                names, _, code = unpack_block(words.as_py(), data.as_py())
                q = Lookups(names, code, m)
                runs, shards = [], q.shards()
                for shard in shards:
                    _, t = q.of(shard)
                    runs.append(pack_run(*steps(q.a[q.pair_of[t]], q.b[q.pair_of[t]]), q.c[t]))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([block] * len(shards), pa.int64()), pa.array(runs, pa.binary())], names=["shard", "block", "run"])

    return block_rows.select("block", "words", "data").mapInArrow(run, "shard long, block long, run binary")


def answer(t: Trie, a: np.ndarray, b: np.ndarray, c: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantised values of sorted distinct triples: p3 of each, p2 and rest2 of each distinct pair in front, rest1 of each distinct first word."""
    new2 = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    pair, a2, b2 = np.cumsum(new2) - 1, a[new2], b[new2]
    new1 = np.append(True, a2[1:] != a2[:-1])
    roots = t.roots.find(a2[new1])
    rest1 = np.where(roots >= 0, t.rest1[np.maximum(roots, 0)], 0).astype(np.uint16)
    root = roots[np.cumsum(new1) - 1]
    p3, place = np.full(len(a), NONE, np.uint16), np.full(len(a2), -1, np.int64)
    p2, rest2 = np.full(len(a2), NONE, np.uint16), np.zeros(len(a2), np.uint16)
    own = np.flatnonzero((root >= 0) & (b2 <= start))
    place[own] = t.children(t.children1, t.nodes2, root[own], b2[own])
    own = own[place[own] >= 0]
    p2[own], rest2[own] = t.p2[place[own]], t.rest2[place[own]]
    use = np.flatnonzero((place[pair] >= 0) & (c < start))
    node = t.children(t.children2, t.nodes3, place[pair[use]], c[use])
    p3[use[node >= 0]] = t.p3[node[node >= 0]]
    return p3, p2, rest2, rest1


def answers(questions: DataFrame, model: Model) -> DataFrame:
    """The runs meet the trie of their shard, which a task opens once; a row of ``BLOCK`` for each run."""
    m = model.numbers()
    files = model.tries.select("shard", F.lit(-1).cast("long").alias("block"), F.col("file").cast("binary").alias("run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, trie = None, None
        for part in (batch.slice(lo, 64) for batch in batches for lo in range(0, batch.num_rows, 64)):
            out = []
            for shard, block, raw in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if block < 0:  # the shard's file, before its runs
                    opened, trie = shard, Trie(m.root, bytes(raw).decode())
                elif shard == opened:
                    da, db, c = unpack_run(bytes(raw), 3)
                    p3, p2, rest2, rest1 = answer(trie, *unsteps(da, db), c.astype(np.int64), m.start)
                    out.append((block, shard, pack_run(p2, rest2), pack_run(np.append(p3, rest1))))
            if out:
                block, shard, pairs, triples = zip(*out, strict=True)
                none = [pa.nulls(len(out), pa.list_(k)) for k in (pa.int64(), pa.bool_(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(shard), *none, pa.array(pairs, pa.binary()), pa.array(triples, pa.binary())], names=["block", "shard", "doc_ids", "held", "sizes", "words", "data"])

    rows = questions.unionByName(files).repartition(model.shards, "shard").sortWithinPartitions("shard", "block")
    return rows.mapInArrow(run, BLOCK)


def finish(m: Model):
    """A map over blocks, each followed by its answers, to a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["block"]):
            names, counts, code = unpack_block(g.column("words")[0].as_py(), g.column("data")[0].as_py())
            q = Lookups(names, code, m)
            p3, p2, rest2, rest1 = np.zeros(len(q.c)), np.zeros(len(q.a)), np.ones(len(q.a)), np.ones(len(q.a))
            for k in range(1, len(g)):
                pairs, triples = q.of(g.column("shard")[k].as_py())
                values = _VALUE[unpack_run(g.column("data")[k].as_py(), 1)[0]]
                p3[triples] = values[: len(triples)]
                p2[pairs], rest2[pairs] = (_VALUE[x] for x in unpack_run(g.column("words")[k].as_py(), 2))
                a = q.a[pairs]
                rest1[pairs] = values[len(triples) + np.cumsum(np.append(True, a[1:] != a[:-1])) - 1]
            if len(m.hot):
                h = np.minimum(np.searchsorted(m.hot, q.a), len(m.hot) - 1)
                rest1 = np.where(m.hot[h] == q.a, m.hot_rest[h], rest1)
            n = counts[q.word]
            p1 = (n + 0.5) / (m.tokens + 0.5 * (m.words + 1))
            context, own = q.pair[q.token], q.pair[q.token + 1]
            p = p3[q.triple[q.token]] + rest2[context] * (p2[own] + rest1[own] * p1)
            keys, held, sizes = (g.column(c).chunk(0)[:1].flatten() for c in ("doc_ids", "held", "sizes"))
            first = np.cumsum(sizes.to_numpy()) - sizes.to_numpy()
            known, base = np.add.reduceat((n > 0).astype(np.int64), first), np.add.reduceat(np.log10(p1), first)
            score = np.add.reduceat(np.log10(np.maximum(p, 1e-300)), first)
            cols = [keys, held, sizes, pa.array(known), pa.array(np.full(len(sizes), m.tokens)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, model: Model, held_out: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The texts become blocks of ids; the distinct triples of a block are asked of their shards by one shuffle, and
    the answers return to the block by another. A task opens the tries of its own shards only, each once. The look-ups
    are done and written when this returns: the result reads the model no more."""
    tables = Tables(docs.sparkSession, "lm-scores")
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text}`").alias("text"))
    m = model.numbers()
    rows = tables.save(coded(src, m), "blocks")
    if model.tries is not None:
        rows = rows.unionByName(tables.save(answers(asked(rows, m), model), "answers"))
    out = rows.repartition("block").sortWithinPartitions("block", "shard")
    return out.mapInArrow(finish(m), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
