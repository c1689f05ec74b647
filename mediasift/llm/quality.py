"""Quality rules on repetition: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of word n-grams are taken over a block of many documents at once in numpy. For
2 to 4 words the measure is the share of word characters inside the most frequent n-gram (of a tie, of that with
the most), each character once however many occurrences overlap on it; for
5 to 10 words the share covered by any n-gram that occurs twice or more; for lines the shares of
lines and of their characters that repeat an earlier line. A document fails when a share is over
its limit. The operator is a map over documents: no shuffle, any row order, bounded memory.

Words are runs of anything but space and 0x09-0x0D. Null and empty texts have no words and fail the
base rule. Repeated rows and ties are judged alike; other columns are not read, so clashing names
cannot matter. Counts cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediasift.llm.arrow_text import Block, Words, blocks, mix, owner, runs_of, span_hashes, sums, windows

#: Published limits on repetition (the rules of a well-known web-text filter), by n-gram length.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SHARES = [f"top_{n}gram_share" for n in TOP_LIMITS] + [f"dup_{n}gram_share" for n in DUPLICATE_LIMITS] + ["dup_line_share", "dup_line_char_share"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in SHARES)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for keys that occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for words inside a window of n words at one of the starts."""
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(block: Block) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but the key, for the documents of a block."""
    words, rows, data = Words(block), len(block), block.data
    lead = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(lead)])
    chars = total[words.ends] - total[words.starts]
    n_words, word_chars = np.diff(words.first), sums(chars, words.first)
    share_of = np.maximum(word_chars, 1)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": sums(SYMBOLS[data], block.offsets)}
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))[words.row]

    shares: dict[str, np.ndarray] = {}
    total_chars = np.concatenate([[0], np.cumsum(chars)])
    for n in TOP_LIMITS:
        h, ok = windows(words.hashes, words.first, n)
        at = np.flatnonzero(ok)
        shares[f"top_{n}gram_share"] = top_share(h[at] ^ salt[at], at, n, words, total_chars) / share_of
    live = None
    repeat_words = np.zeros(rows, np.int64)
    for n in DUPLICATE_LIMITS:
        h, ok = windows(words.hashes, words.first, n)
        # a repeated n-gram begins with a repeated shorter one: only those are sorted
        if live is None:
            at = np.flatnonzero(ok)
        else:
            at = live[live < len(ok)]
            at = at[ok[at]]
        live = at[repeated(h[at] ^ salt[at])]
        inside = covered(live, n, len(chars))
        shares[f"dup_{n}gram_share"] = sums(np.where(inside, chars, 0), words.first) / share_of
        if n == 8:
            repeat_words = sums(inside, words.first)

    not_break = data != 0x0A
    ls, le = runs_of(not_break, block.offsets)
    row, first = owner(block.offsets, ls)
    has_word = np.searchsorted(words.starts, ls) < np.searchsorted(words.starts, le)
    line_chars = total[le] - total[ls]
    at = np.flatnonzero(has_word)
    key = span_hashes(data, ls[at], le[at]) ^ mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    again = np.zeros(len(ls), dtype=bool)
    again[at[order[1:]]] = s[1:] == s[:-1]
    out["n_dup_lines"] = sums(again, first)
    shares["dup_line_share"] = out["n_dup_lines"] / np.maximum(sums(has_word, first), 1)
    shares["dup_line_char_share"] = sums(np.where(again, line_chars, 0), first) / np.maximum(sums(np.where(has_word, line_chars, 0), first), 1)

    out["n_repeat_words"] = repeat_words
    out["base_failed"] = (n_words < 20) | (100 * repeat_words > 30 * n_words)
    failed = out["base_failed"] | (shares["dup_line_share"] > LINE_LIMIT) | (shares["dup_line_char_share"] > LINE_CHAR_LIMIT)
    for n, limit in TOP_LIMITS.items():
        failed = failed | (shares[f"top_{n}gram_share"] > limit)
    for n, limit in DUPLICATE_LIMITS.items():
        failed = failed | (shares[f"dup_{n}gram_share"] > limit)
    return out | {"kept": ~failed} | shares


def top_share(key: np.ndarray, at: np.ndarray, n: int, words: Words, total: np.ndarray) -> np.ndarray:
    """Characters inside the occurrences of each document's most frequent n-gram (of a tie, of that with the most);
    zero where no n-gram occurs twice. ``total`` has the characters before each word."""
    best = np.zeros(len(words.first) - 1, np.int64)
    again = np.flatnonzero(repeated(key))
    if not len(again):
        return best
    again = again[np.argsort(key[again], kind="stable")]  # by n-gram, then by place
    start = at[again]
    new = np.append(True, key[again][1:] != key[again][:-1])
    # an occurrence adds the words that the one before does not reach
    reached = np.where(new, 0, np.append(0, start[:-1]) + n)
    added = total[start + n] - total[np.maximum(start, reached)]
    first = np.flatnonzero(new)
    size, count, row = np.add.reduceat(added, first), np.diff(np.append(first, len(start))), words.row[start[first]]
    order = np.lexsort((size, count, row))
    pick = order[np.append(row[order][1:] != row[order][:-1], True)]
    best[row[pick]] = size[pick]
    return best


def repetition_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, repetition shares and the verdict of every document."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                got = measure(block)
                cols = [batch.column(0).slice(block.lo, len(block))] + [pa.array(got[c]) for c in names[1:]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)
