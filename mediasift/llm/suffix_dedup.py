"""Removal of every byte inside a string of ``length`` bytes that also starts anywhere else.

Equal strings must meet in one task. Each start of such a string is given a bucket, the least
hash among the short grams inside the string, so equal strings share a bucket, and neighbouring
starts mostly do too: a text becomes a few segments (runs of starts with one least gram). Equal segments
of a bucket are carried once with their count. In each bucket with several different segments
repeats are found by threshold-bounded interval expansion on a Burrows-Wheeler transform:
breadth-first backward extension finds the boundaries between neighbouring suffixes by increasing
common prefix, and stops at ``length``; boundaries not met by then have a common prefix of at least
that. Many buckets are transformed together.

A bucket with more than ``most_segments`` different segments (one passage in countless contexts) is
cut again with longer grams, and at last with whole strings, so no bucket has to be held in one
task. Counting is pre-aggregated, joins on hot keys are left to adaptive skew handling, and
texts are shuffled only to cut wanted segments and to remove spans.

Strings never cross documents; the text is taken as UTF-8 bytes, a null text as empty. Repeated rows
repeat each other. Documents are told apart by key and a hash of the text, so null and repeated keys
are safe. A long text is cut like any other, into segments that are far shorter than it. Columns other than key and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.arrow_text import BASE, RANDOM, blocks, mix, text_bytes
from mediasift.llm.shared import Tables

LENGTH = 200
#: Gram lengths by which starts are dealt: first, for too large buckets, and for what is left of those.
GRAMS = (0.16, 0.8, 1.0)
MOST_SEGMENTS, BATCH_BYTES = 2048, 1 << 20
SEPARATOR = 0xFF  # in no UTF-8 text


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each place that has so many."""
    power, size, block = np.uint64(BASE), 1, RANDOM[data]
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out, done = block, size
            else:
                m = len(data) - done - size + 1
                out = out[:m] * power + block[done : done + m]
                done += size
        if done == n:
            return mix(out)
        m = len(data) - 2 * size + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        block = block[:m] * power + block[size : size + m]
        power, size = power * power, size * 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w and len(x) > size:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def cut_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of starts and bucket of every segment of the rows at the offsets."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    with np.errstate(over="ignore"):
        grams = gram_hashes(data, gram)
        least = sliding_min(grams, length - gram + 1)
    size = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int32)
    full = size >= length
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return none, none, none
    key = least[at]
    new = np.ones(len(at), bool)
    # a segment also ends where its first least gram goes, so no string repeats inside one segment
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (grams[at[:-1]] == key[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return at[first], count, key[first].view(np.int64)


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Places of the text sorted by the ``length`` bytes or more that follow them (prefix doubling)."""
    n = len(text)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = text
    for k in (1, 2, 4):
        key[: n + 8 - k] = (key[: n + 8 - k] << np.uint64(8 * k)) | key[k:]
    key, h = key[:n], 8
    while True:
        order = np.argsort(key)
        if h >= length:
            return order
        s = key[order]
        rank = np.empty(n + h, np.uint64)
        rank[n:] = 0
        new = np.ones(n, np.uint64)
        new[1:] = s[1:] != s[:-1]
        rank[order] = np.cumsum(new)
        if int(rank[order[-1]]) == n:
            return order
        key = (rank[:n] << np.uint64(32)) | rank[h : n + h]
        h *= 2


def repeated_starts(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True where the ``length`` bytes from a place, without a separator, start at another place too."""
    n = len(text)
    out = np.zeros(n, bool)
    if n <= length:
        return out
    order = suffix_order(text, length)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # the last-to-first mapping
    step[by_symbol] = np.arange(n)
    unmet = np.ones(n + 1, bool)  # boundaries whose common prefix is not yet known
    unmet[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = high - low
        group = np.repeat(np.arange(len(low)), size)
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        symbol = bwt[at]
        inside = symbol != SEPARATOR
        at, symbol, group = at[inside], symbol[inside], group[inside]
        if not len(at):
            break
        sort = np.argsort(symbol, kind="stable")
        symbol, group, place = symbol[sort], group[sort], step[at[sort]]
        new = np.ones(len(place), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        low, high = place[first], place[last] + 1
        go = unmet[high]
        low, high = low[go], high[go]
        unmet[high] = False
        if not len(low):
            break
    out[order] = unmet[:-1] | unmet[1:]
    separators = np.flatnonzero(text == SEPARATOR)
    until = np.append(separators, n)[np.searchsorted(separators, np.arange(n))]
    return out & (until - np.arange(n) >= length)


RUN = "bucket long, seg long, cs long, doc_id long, th long, start long, n long"


def _rows(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def cut_documents(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                start, n, bucket = cut_runs(block.data, block.offsets, length, gram)
                if not len(start):
                    continue
                raw = memoryview(block.data)
                seg = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                row = np.searchsorted(block.offsets, start, "right") - 1
                pick = pa.array(row + block.lo)
                yield _rows(["bucket", "seg", "cs", "doc_id", "th", "start", "n"], bucket, np.array(seg, np.uint64).view(np.int64), np.ones(len(row), np.int64), batch.column(0).take(pick), batch.column(1).take(pick), start - block.offsets[row], n)

    return docs.mapInArrow(run, RUN)


def cut_segments(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of larger buckets, cut with longer grams; rows keep their count and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("bytes")):
                start, n, bucket = cut_runs(block.data, block.offsets, length, gram)
                if not len(start):
                    continue
                raw = block.data.tobytes()
                parts = [raw[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                row = np.searchsorted(block.offsets, start, "right") - 1
                pick = pa.array(row + block.lo)
                begin = batch.column("start").take(pick).to_numpy() + start - block.offsets[row]
                seg = np.array([xxhash.xxh3_64_intdigest(x) for x in parts], np.uint64).view(np.int64)
                yield _rows(["bucket", "seg", "cs", "doc_id", "th", "start", "n", "bytes"], bucket, seg, *(batch.column(c).take(pick) for c in ("cs", "doc_id", "th")), begin, n, pa.array(parts, pa.binary()))

    return segments.mapInArrow(run, RUN + ", bytes binary")


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments; each document meets its list of segments once."""
    names = ["bucket", "seg", "cs", "start", "n"]
    lists = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct(*names)).alias("want"))
    joined = docs.join(lists, (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("doc_id", "th", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # repeated rows have met in this task: one of them is enough
        for batch in batches:
            if len(seen) > 1_000_000:  # a repeat that comes later is work, not a wrong result
                seen.clear()
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            first = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if len(first) < batch.num_rows:
                batch = batch.take(pa.array(first, pa.int64()))
            data, off = text_bytes(batch.column(2))
            lists = batch.column(3)
            raw = memoryview(data)
            for lo in range(0, batch.num_rows, 64):
                part = lists.slice(lo, 64)
                flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
                row = np.repeat(np.arange(lo, lo + len(part)), sizes)
                col = {c: flat.field(c) for c in names}
                a = off[row] + col["start"].to_numpy()
                b = a + col["n"].to_numpy() + length - 1
                pick = pa.array(row)
                yield _rows(["bucket", "seg", "cs", "doc_id", "th", "start", "n", "bytes"], col["bucket"], col["seg"], col["cs"], batch.column(0).take(pick), batch.column(1).take(pick), col["start"], col["n"], pa.array([bytes(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))

    return joined.mapInArrow(run, RUN + ", bytes binary")


def expand(segments: DataFrame, length: int) -> DataFrame:
    """Spans of single segments whose strings start in other segments of their bucket."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        data, off = text_bytes(t.column("bytes"))
        at = np.arange(len(off) - 1)
        text = np.full(len(data) + len(at), SEPARATOR, np.uint8)
        text[np.arange(len(data)) + np.repeat(at, np.diff(off))] = data
        begin = off[:-1] + at
        flag = repeated_starts(text, length)
        n = t.column("n").to_numpy()
        single = t.column("cs").to_numpy() == 1
        own = np.zeros(len(text) + 1, np.int32)
        np.add.at(own, begin[single], 1)
        np.add.at(own, (begin + n)[single], -1)
        flag &= np.cumsum(own[:-1]) > 0
        edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(a):
            return None
        row = np.searchsorted(begin, a, "right") - 1
        base = t.column("start").to_numpy()[row] - begin[row]
        pick = pa.array(row)
        take = lambda c: t.column(c).combine_chunks().take(pick) if isinstance(t.column(c), pa.ChunkedArray) else t.column(c).take(pick)
        return _rows(["doc_id", "th", "a", "b"], take("doc_id"), take("th"), a + base, b - 1 + base + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            _, off = text_bytes(batch.column("bytes"))
            new = np.append(True, bucket[1:] != bucket[:-1])
            new[0] = last is not None and bucket[0] != last
            start = 0
            for cut in np.flatnonzero(new).tolist():
                if size + off[cut] - off[start] >= BATCH_BYTES:
                    held.append(batch.slice(start, cut - start))
                    if (got := solve([x for x in held if x.num_rows])) is not None:
                        yield got
                    held, size, start = [], 0, cut
            held.append(batch.slice(start))
            size += int(off[-1] - off[start])
            last = bucket[-1]
        if held and (got := solve([x for x in held if x.num_rows])) is not None:
            yield got

    return segments.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, th long, a long, b long")


def repeated_spans(tables: Tables, docs: DataFrame, length: int, most_segments: int) -> DataFrame:
    """Rows (doc_id, th, a, b): spans of repeated strings, overlapping and unordered."""
    spans, level = [], None
    for k, share in enumerate(GRAMS):
        gram = max(1, min(length, round(length * share)))
        inline = k > 0
        runs = tables.save(cut_segments(level, length, gram) if inline else cut_documents(docs, length, gram), f"runs{k}")
        # buckets met once hold no repeat
        # written first, so that the join's sides are plain shuffles and a hot bucket can be split
        sizes = tables.save(runs.groupBy("bucket").agg(F.sum("cs").alias("c")).where("c > 1").select("bucket"), f"sizes{k}")
        found = tables.save(runs.join(sizes, "bucket"), f"found{k}")
        tables.drop(f"runs{k}", f"sizes{k}")
        columns = ["doc_id", "th", "start", "n", *(["bytes"] if inline else [])]
        segs = tables.save(found.groupBy("bucket", "seg").agg(F.sum("cs").alias("total"), F.min(F.struct(*columns)).alias("rep")), f"segs{k}")
        whole = found.where("cs = 1").join(segs.where("total > 1").select("bucket", "seg"), ["bucket", "seg"])
        spans.append(tables.save(whole.select("doc_id", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")), f"whole{k}"))
        tables.drop(f"found{k}")
        many = segs.groupBy("bucket").agg(F.count(F.lit(1)).alias("segments")).where("segments > 1")
        wanted = segs.join(many, "bucket").select("bucket", "seg", F.col("total").alias("cs"), "rep.*", "segments")
        wanted = tables.save(wanted, f"wanted{k}")
        tables.drop(f"segs{k}")
        if not inline:
            cut = tables.save(fetch(docs, wanted, length).join(wanted.select("bucket", "segments").distinct().where(F.col("segments") > most_segments), "bucket", "left"), f"cut{k}")
        else:
            cut = wanted.withColumn("segments", F.when(F.col("segments") > most_segments, F.col("segments")))
        spans.append(tables.save(expand(cut.where("segments is null").drop("segments"), length), f"spans{k}"))
        level = cut.where("segments is not null").drop("segments")
        if level.isEmpty():
            break
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, most_segments: int = MOST_SEGMENTS, keep_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the
    remaining bytes as ``kept``."""
    tables = Tables(docs.sparkSession, "suffix")
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(tables, source, length, most_segments)
    lists = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = source.join(lists, (F.col("th") == F.col("s_th")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            removed, runs, digests, texts = [], [], [], []
            for lo in range(0, batch.num_rows, 256):
                lists = batch.column(2).slice(lo, 256)
                for k in range(len(lists)):
                    raw = data[off[lo + k] : off[lo + k + 1]]
                    found = lists[k]
                    if found.is_valid:
                        a, b = found.values.field("a").to_numpy(), found.values.field("b").to_numpy()
                        edge = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(edge, a, 1)
                        np.add.at(edge, b, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed.append(int(gone.sum()))
                        runs.append(int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()))
                        raw = raw[~gone]
                    else:
                        removed.append(0)
                        runs.append(0)
                    raw = raw.tobytes()
                    digests.append(hashlib.sha256(raw).hexdigest())
                    if keep_text:
                        texts.append(raw)
            cols = [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            yield _rows(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])], *cols, *([pa.array(texts, pa.binary())] if keep_text else []))

    return joined.mapInArrow(run, schema)
