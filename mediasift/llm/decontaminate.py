"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every document is scanned for word n-grams of the test items, its seeds. Rare seeds, those of at most ``RARE``
items, come first: each place where one lies joins the document to its items. A seed of more items (a stem that they
share) is opened only for the items that can still be worth enough there: of those, the stretch of the document around
the seed must have so many of the item's rarer words that, with all its common ones, the worth could be reached. These items
are found from the stretch's rarer words, so a common seed does not cost a step for each item that has it. However
many documents hold a seed does not matter. Each place gives a window of the document, which is dropped
only if it has too few of the item's words for any alignment to be worth enough. Both are upper bounds, so
no pair is lost by them. What is left is aligned with the item, by local alignment of words; the score is
a share of the score of a whole exact copy, and must reach ``min_score``, or the worth of
``ENOUGH_WORDS`` words in a long item, and the worth of ``LEAST_WORDS`` words (of the whole item, if
shorter). Edited and paraphrased copies keep some seeds and most of the alignment.

The items are taken in blocks of at most ``block_words`` words, each broadcast in turn: that is the
bound on what is broadcast. Documents are never shuffled and each one is handled whole, so a hot
passage or source costs no more than its share. Words are runs of letters, digits and bytes above
0x7F, in lower case. Null or empty documents and items match nothing; an item shorter than the
seed uses one seed of all its words. Repeated documents and items give a row each. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.arrow_text import Block, Words, blocks, mix, sums, windows

SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of an item (or the whole item) that the alignment must be worth.
LEAST_WORDS = 8
#: Words that are enough, whatever their share of the item.
ENOUGH_WORDS = 30
#: Items of a rare seed; a word of more items, or of more than this share of them, is common. Words of a stretch, at least.
RARE, COMMON_SHARE, STRETCH = 16, 1 / 16, 256
#: Windows of documents, and words of windows, that are handled at once.
MOST_WINDOWS, MOST_WORDS = 1 << 20, 1 << 21


class Items:
    """A block of test items: word hashes, seeds and a bitmap that rejects most other n-grams."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        self.ids, self.n = ids, n
        array = pa.array(texts, pa.string())
        words = lowered_words(next(iter(blocks(array, 1 << 62)), None))
        self.codes, self.first = (words.hashes, words.first) if words else (np.zeros(0, np.uint64), np.zeros(len(ids) + 1, np.int64))
        seeds, items, places = [], [], []
        for size in range(1, n + 1):
            h, ok = windows(self.codes, self.first, size)
            count = np.diff(self.first)
            row = np.repeat(np.arange(len(ids)), count)[: len(h)]
            # shorter items have one seed of all their words
            at = np.flatnonzero(ok & ((count[row] == size) | (size == n)))
            seeds.append(mix(h[at] + np.uint64(size)))
            items.append(row[at])
            places.append(at - self.first[row[at]])
        seed, item, place = map(np.concatenate, (seeds, items, places))
        self.sizes = sorted({min(n, int(c)) for c in np.diff(self.first) if c})
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.keys, self.key_first = np.unique(self.seed, return_index=True)
        self.key_first = np.append(self.key_first, len(self.seed))
        self.bits = max(10, int(len(self.keys) * 64).bit_length())
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self._common()
        self.word_bits = max(10, int(len(self.codes) * 16).bit_length())
        self.words = np.zeros(1 << self.word_bits, dtype=bool)
        self.words[self.word_places(self.codes, np.repeat(np.arange(len(ids)), np.diff(self.first)))] = True

    def _common(self) -> None:
        """For seeds of many items: their keys by item, and the items by their rarer words, with how often they have each."""
        span = np.diff(self.key_first)
        self.frequent = span > RARE
        key_of = np.repeat(np.arange(len(self.keys)), span)
        mine = np.flatnonzero(self.frequent[key_of])
        order = mine[np.argsort(self.item[mine], kind="stable")]
        self.by_item, self.by_item_key = order, key_of[order]
        self.by_item_first = np.searchsorted(self.item[order], np.arange(len(self.ids) + 1))
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        pairs, times = np.unique(np.stack([self.codes, row.astype(np.uint64)]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
        vocabulary, first, n_items = np.unique(pairs[0], return_index=True, return_counts=True)
        rarer = n_items <= max(RARE, COMMON_SHARE * len(self.ids))
        keep = np.repeat(rarer, n_items)
        self.rarer, self.rarer_item, self.rarer_times = vocabulary[rarer], pairs[1][keep].astype(np.int64), times[keep]
        self.rarer_first = np.append(0, np.cumsum(n_items[rarer]))
        self.n_common = np.diff(self.first) - np.bincount(self.rarer_item, self.rarer_times, len(self.ids)).astype(np.int64)
        self.stretch = max(STRETCH, 3 * int(np.diff(self.first).max(initial=0)))

    def least(self, min_score: float) -> np.ndarray:
        """The share of each item that an alignment must be worth: short items need more of themselves (eight
        words, or all of them); of long items thirty words are enough."""
        size = np.maximum(np.diff(self.first), 1)
        return np.maximum(np.minimum(min_score, ENOUGH_WORDS / size), np.minimum(1.0, LEAST_WORDS / size))

    def word_places(self, codes: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Places in the bitmap ``words`` of words of items; true there for each word that the item has."""
        return (mix(codes ^ mix(item.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - self.word_bits)).astype(np.int64)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of seeds among the words, and the index of each in ``keys``."""
        found, key = [], []
        for size in self.sizes:
            h, ok = windows(words.hashes, words.first, size)
            h = mix(h + np.uint64(size))
            at = np.flatnonzero(ok & self.map[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[at]), max(len(self.keys) - 1, 0))
            true = self.keys[k] == h[at] if len(self.keys) else np.zeros(len(at), bool)
            found.append(at[true])
            key.append(k[true])
        return (np.concatenate(found), np.concatenate(key)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def lowered_words(block: Block | None) -> Words | None:
    return None if block is None else Words(block, SEPARATORS)


def lower(array):
    return pc.utf8_lower(array)


def smith_waterman(items: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of ``items`` with the same row of ``docs``.

    Codes are compared for equality; 0 pads items, 1 pads documents. One numpy pass per item word;
    gaps along the document are resolved by a running maximum.
    """
    rows, width = docs.shape
    slope = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((rows, width + 1), np.int32)
    best = np.zeros(rows, np.int32)
    for j in range(items.shape[1]):
        code = items[:, j : j + 1]
        diagonal = above[:, :-1] + np.where(docs == code, MATCH, MISMATCH)
        cell = np.maximum(np.maximum(diagonal, above[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        cell[(items[:, j] == 0)] = 0
        best = np.maximum(best, cell.max(axis=1))
        above[:, 1:] = cell
    return best


def portions(cost: np.ndarray, most: int) -> list[np.ndarray]:
    """Runs of indices whose costs add up to about ``most``."""
    turn = np.cumsum(cost) // most
    return np.split(np.arange(len(cost)), np.flatnonzero(np.diff(turn)) + 1) if len(cost) else []


def align(items: Items, words: Words, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items and scores of the pairs that reach ``min_score``."""
    at, key = items.hits(words)
    rare = ~items.frequent[key]
    found = []
    for part in portions(np.diff(items.key_first)[key[rare]], MOST_WINDOWS):
        pair, member = expanded(items.key_first, key[rare][part])
        found.append(align_windows(items, words, min_score, at[rare][part][pair], member))
    for place, member in common_seeds(items, words, min_score, at[~rare], key[~rare]):
        found.append(align_windows(items, words, min_score, place, member))
    row, item, score = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(row):
        return row, item, score
    pairs, back = np.unique(np.stack([row, item]), axis=1, return_inverse=True)
    top = np.zeros(pairs.shape[1])
    np.maximum.at(top, back.ravel(), score)
    return pairs[0], pairs[1], top


def expanded(first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of rows that begin at ``first``: the index of each asked group, and each of its rows."""
    span = first[group + 1] - first[group]
    pair = np.repeat(np.arange(len(group)), span)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(span) - span, span) + first[group][pair]


def common_seeds(items: Items, words: Words, min_score: float, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of seeds of many items, with the items' seeds (members) that can still be worth enough there."""
    if not len(at):
        return
    size = np.diff(items.first)
    lacking = items.least(min_score) * size - items.n_common - 1e-6  # rarer words that an item needs at least
    # a window lies in the stretch of its seed and the two beside it; between rows there is an empty one
    per_row = np.diff(words.first) // items.stretch + 2
    begin = np.cumsum(per_row) - per_row + 1
    stretch = begin[words.row[at]] + (at - words.first[words.row[at]]) // items.stretch
    order = np.lexsort((key, stretch))
    at, key, stretch = at[order], key[order], stretch[order]
    hits = stretch * len(items.keys) + key
    asked = np.unique(stretch)
    for few in np.array_split(asked, -(-len(asked) // 64)):
        near = np.unique((few[:, None] + [-1, 0, 1]).ravel())
        row = np.searchsorted(begin - 1, near, "right") - 1
        lo = words.first[row] + (near - begin[row]) * items.stretch
        hi = np.minimum(lo + items.stretch, words.first[row + 1])
        inside = (near >= begin[row]) & (lo < hi)
        near, lo, hi = near[inside], lo[inside], hi[inside]
        place = np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        if len(items.rarer):
            code = np.minimum(np.searchsorted(items.rarer, words.hashes[place]), len(items.rarer) - 1)
            known = items.rarer[code] == words.hashes[place]
            seen = np.unique(np.stack([np.repeat(near, hi - lo)[known], code[known]]), axis=1)
        else:
            seen = np.zeros((2, 0), np.int64)
        total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part in portions(np.diff(items.rarer_first)[seen[1]], MOST_WORDS):
            pair, entry = expanded(items.rarer_first, seen[1][part])
            target = (seen[0][part][pair][:, None] + [-1, 0, 1]).ravel() * len(items.ids) + np.repeat(items.rarer_item[entry], 3)
            code, back = np.unique(np.concatenate([total[0], target]), return_inverse=True)
            total = code, np.bincount(back.ravel(), np.concatenate([total[1], np.repeat(items.rarer_times[entry], 3)])).astype(np.int64)
        where, item = np.divmod(total[0], max(len(items.ids), 1))
        enough = (total[1] >= lacking[item]) & np.isin(where, few)
        # items whose common words are enough need no other
        always = np.flatnonzero(lacking <= 0)
        always = always[np.diff(items.by_item_first)[always] > 0]
        where = np.concatenate([where[enough], np.repeat(few, len(always))])
        item = np.concatenate([item[enough], np.tile(always, len(few))])
        for part in portions(np.diff(items.by_item_first)[item] + 1, MOST_WINDOWS):
            pair, entry = expanded(items.by_item_first, item[part])
            wanted = where[part][pair] * len(items.keys) + items.by_item_key[entry]
            first, last = np.searchsorted(hits, wanted, "left"), np.searchsorted(hits, wanted, "right")
            for some in portions(last - first, MOST_WINDOWS):
                span = (last - first)[some]
                which = np.repeat(some, span)
                hit = np.arange(len(which)) - np.repeat(np.cumsum(span) - span, span) + first[which]
                if len(hit):
                    yield at[hit], items.by_item[entry[which]]


def align_windows(items: Items, words: Words, min_score: float, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items and scores of the windows around seeds (places and members of the items' seeds) that are worth enough."""
    item = items.item[member]
    row = words.row[at]
    begin = at - items.place[member] - words.first[row]  # where the item's first word would lie
    # one window for each place (in steps of half an item) where an item may begin
    cell = begin // np.maximum(np.diff(items.first)[item] // 2, 4)
    order = np.lexsort((cell, item, row))
    row, item, cell = row[order], item[order], cell[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
    row, item, cell = row[new], item[new], cell[new]
    size = np.diff(items.first)[item]
    step = np.maximum(size // 2, 4)
    lo = words.first[row] + np.maximum(cell * step - step, 0)
    hi = np.minimum(words.first[row + 1], words.first[row] + np.maximum((cell + 2) * step + size, 0))
    least = items.least(min_score)[item]
    # an alignment is worth no more words than the window has of the item's
    most = np.zeros(len(row))
    for part in portions(hi - lo, MOST_WORDS):
        wide = (hi - lo)[part]
        first = np.append(0, np.cumsum(wide))
        place = np.arange(first[-1]) + np.repeat(lo[part] - first[:-1], wide)
        most[part] = sums(items.words[items.word_places(words.hashes[place], np.repeat(item[part], wide))], first)
    some = np.flatnonzero(most >= least * size - 1e-6)
    row, item, size, lo, hi, least = row[some], item[some], size[some], lo[some], hi[some], least[some]
    score = np.zeros(len(row))
    order = np.argsort(size, kind="stable")
    for part in np.array_split(order, max(1, int((size * (hi - lo)).sum() // 2_000_000))):
        if len(part):
            a, b = pad(items.codes, items.first[item[part]], size[part], 0), pad(words.hashes, lo[part], (hi - lo)[part], 1)
            score[part] = smith_waterman(a, b) / (MATCH * np.maximum(size[part], 1))
    good = score >= least
    return row[good], item[good], score[good]


def pad(codes: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(start), max(int(size.max()), 1)), fill, np.uint64)
    col = np.arange(out.shape[1])
    mask = col < size[:, None]
    out[mask] = codes[(start[:, None] + col)[mask]] | np.uint64(2)
    return out


def item_blocks(benchmark: DataFrame, item_key: str, text: str, n: int, block_words: int) -> Iterator[Items]:
    """The test set in blocks of at most ``block_words`` words, or of a single longer item."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(f"`{item_key}`"), F.lower(F.col(f"`{text}`"))).toLocalIterator():
        count = len((row[1] or "").split()) + 1
        if ids and size + count > block_words:
            yield Items(ids, texts, n)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += count
    if ids:
        yield Items(ids, texts, n)


_sent: list = []


def release() -> None:
    """Frees the items sent to executors by results that have been written."""
    while _sent:
        _sent.pop().unpersist()


def passes(docs: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, n: int, block_words: int) -> Iterator:
    """A broadcast of each block of items; ``release`` frees them."""
    for items in item_blocks(benchmark, item_key, item_text, n, block_words):
        _sent.append(docs.sparkSession.sparkContext.broadcast(items))
        yield _sent[-1]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 3, min_score: float = 0.4, block_words: int = 2_000_000) -> DataFrame:
    """A row for each document and item it contains: key, item_id, score (0 to 1)."""
    schema = f"key {docs.schema[key].dataType.simpleString()}, item {benchmark.schema[item_key].dataType.simpleString()}, score double"
    source, out = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), None
    for kept in passes(docs, benchmark, item_key, item_text, n, block_words):

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            ids = pa.array(kept.value.ids)
            for batch in batches:
                for block in blocks(lower(batch.column(1))):
                    row, item, score = align(kept.value, lowered_words(block), min_score)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + block.lo)), ids.take(pa.array(item)), pa.array(score)], names=["key", "item", "score"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.toDF(key, item_key, "score")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 3, min_score: float = 0.4, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no item, judged where they are read: nothing is shuffled."""
    out, place = docs, docs.columns.index(text)
    for kept in passes(docs, benchmark, item_key, item_text, n, block_words):

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in blocks(lower(batch.column(place))):
                    clean[align(kept.value, lowered_words(block), min_score)[0] + block.lo] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
