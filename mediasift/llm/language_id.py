"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams of one to ``max_n`` characters per language in ``2**bits`` buckets, as a
Spark aggregation over a sample of about ``sample_docs`` labelled documents, which has about
``LEAST_DOCS`` of each language at least, or all if it has fewer; the languages' shares are those of all
labelled documents. The matrix of
log-probabilities has ``2**bits`` rows and a column per language, so its size does not depend on
the data's; it is broadcast. Scoring is a map: each block of documents becomes a sparse list of
buckets, whose rows of the matrix are added up per document in numpy.

Letters are lower-cased; anything else is one space between letters. A null text, or one without
letters, is ``und`` with score 0, as is every text when no labelled document was given. Equal
scores go to the first language in alphabetical order. Texts of any length are scored whole. A null key has no
fold: ``fit`` may learn from its rows, and tells rows that share a key apart by their text. Repeated rows score alike; an empty table
gives an empty table; only the key and the text are read when predicting. Columns of the input with
the names of the two added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.arrow_text import Block, blocks, owner

UNKNOWN = "und"
#: About so many documents of each language are learned from, however rare it is.
LEAST_DOCS = 1_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 32 for any other character."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def features(block: Block, bits: int, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets of its n-grams, the row of each, and where each row's begin."""
    raw = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    off = lead[block.offsets]
    code = _letters()[raw]
    letter = code != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = off[:-1][np.diff(off) > 0]
    keep[starts] = letter[starts]  # no space before a text's first letter
    at = np.flatnonzero(keep)
    row, first = owner(off, at)
    code = code[at]
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max_n + 1):
        size = len(code) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint32(0x01000193) + code[n - 1 :] * np.uint32(0x9E3779B1)
        x = h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        inside = row[:size] == row[n - 1 :]
        if n == 1:
            inside = code != 32
        bucket = (x >> np.uint32(32 - bits))[inside].astype(np.int64)
        rows = row[:size][inside]
        yield bucket, rows, np.searchsorted(rows, np.arange(len(block) + 1))


class NaiveBayes:
    """A fitted model: languages in alphabetical order and the matrix of log-probabilities."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, log_prior: np.ndarray, bits: int, max_n: int):
        self.languages, self.log_prob, self.log_prior, self.bits, self.max_n = languages, log_prob, log_prior, bits, max_n

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each document (-1: none) and its posterior probability."""
        rows = len(block)
        best, score = np.full(rows, -1), np.zeros(rows)
        if not self.languages or not len(block.data):
            return best, score
        total, some = np.tile(self.log_prior, (rows, 1)), np.zeros(rows, bool)
        for bucket, _, first in features(block, self.bits, self.max_n):
            full = np.flatnonzero(np.diff(first) > 0)
            if len(full):
                total[full] += np.add.reduceat(self.log_prob[bucket], first[full], axis=0, dtype=np.float64)
                some[full] = True
        top = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(some, top, -1), np.where(some, np.minimum(p, 1.0), 0.0)


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 20_000, bits: int = 16, max_n: int = 3, alpha: float = 0.1) -> NaiveBayes:
    """Fit on about ``sample_docs`` labelled documents and at least ``LEAST_DOCS`` of each language, chosen
    by a hash of key and text; on all if there are fewer."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col(key), F.col(text)), F.lit(1 << 30))
    # a row per language; the document at the least place is taken in any case, with its repeats
    known = {r[0]: (r[1], r[2]) for r in rows.groupBy(F.col(lang)).agg(F.count(F.lit(1)), F.min(place)).collect()}
    n = sum(c for c, _ in known.values())
    if n > sample_docs:
        limits = {name: max(int((1 << 30) * max(sample_docs / n, min(1.0, LEAST_DOCS / c))), first + 1) for name, (c, first) in known.items()}
        limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(lang)]
        rows = rows.where(place < limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=str), return_inverse=True)
            for block in blocks(batch.column(1)):
                own = code[block.lo : block.hi]
                for bucket, row, _ in features(block, bits, max_n):
                    seen, n = np.unique(own[row] << bits | bucket, return_counts=True)
                    cuts = np.searchsorted(seen >> bits, np.arange(len(names) + 1))
                    for k in np.unique(own).tolist():
                        if names[k] not in totals:
                            totals[names[k]] = np.zeros(1 << bits, np.int64)
                        part = slice(cuts[k], cuts[k + 1])
                        totals[names[k]][seen[part] & ((1 << bits) - 1)] += n[part]
        for name, t in sorted(totals.items()):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["lang", "bucket", "n"])

    # at most 2**bits rows a language, whatever the size of the input
    counts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(known)
    table = np.zeros((len(languages), 1 << bits))
    docs = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        table[i, own["bucket"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        docs[i] = known[name][0]
    log_prob = np.log((table + alpha) / (table.sum(axis=1, keepdims=True) + alpha * (1 << bits)))
    return NaiveBayes(languages, np.ascontiguousarray(log_prob.T.astype(np.float32)), np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), bits, max_n)


def identify(docs: DataFrame, model: NaiveBayes, *, text: str = "text", keep: list[str] | None = None, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all) with the predicted language and its probability."""
    names = [n for n in (docs.columns if keep is None else keep) if n not in (lang_col, score_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"c{i}" for i in range(len(names))]
    src = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{n}`").alias(o) for n, o in zip(names, own, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for block in blocks(batch.column(0)):
                best, score = m.predict(block)
                cols = [batch.column(i + 1).slice(block.lo, len(block)) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(labels[best].tolist(), pa.string()), pa.array(score)], names=[*own, "lang_pred", "score"])

    schema = ", ".join([f"{o} {docs.schema[n].dataType.simpleString()}" for n, o in zip(names, own, strict=True)] + ["lang_pred string", "score double"])
    return src.mapInArrow(run, schema).toDF(*names, lang_col, score_col)


def hash_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n
