"""Token ids in files of directly addressable codes.

Each id is cut into chunks of fixed widths, lowest first. Level 0 holds the first chunk of every
id; a bitmap tells which ids go on, and level k + 1 holds the next chunk of just those. The place of
an id on the next level is the rank of its bit, which a directory of counts (one for each 512 bits)
gives with a few popcounts, so any token is read without decoding its neighbours.

Documents are range-partitioned by key, so files are in ascending key order; each task writes files
of about ``shard_tokens`` ids. A file's name holds the task attempt; the manifest, a Parquet table
written with the files, names those of the attempts that succeeded, so lost executors, retries and
speculation leave at most unlisted files. Only the manifest (a row a file) is used to number tokens.

Readers open the sections of a file that they need: ``tokens_at`` reads single tokens of the whole store by
position, ``read_documents`` the ids of single documents, by pages of ``PAGE`` bytes; ``read_tokens`` goes through
all documents, and gets each one's ids by their places as well.

A null or empty text has the end id alone. Null keys come first. Rows with equal keys come in the order of a
hash of the text, and a key that many rows share is split by that hash. Rows that agree in key and text are interchangeable:
where there are more than ``HOT`` they are counted, and dealt by blocks of ``COPIES`` of which one row carries the text, which is
encoded once for all of them. Repeated rows are all written. An empty table has an empty manifest.
Only the key and the text are read. Texts of any length are encoded whole.

File: 8 bytes of magic, the header's length (unsigned 64-bit, little-endian), a JSON header, then
sections aligned to 8 bytes: doc ids, a null flag for each, cumulative token counts, and for each
level chunks, continuation bits (least significant first) and rank counts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasift.llm.arrow_text import blocks
from mediasift.llm.shared import Tables

MAGIC = b"MSDAC\x00\x01\n"
RANK_BITS = 512
#: Bytes that are read at once by position, and places whose ids are got at once.
PAGE, PLACES = 1 << 16, 1 << 18
#: Words that an encoder keeps, the longest of them, and words that it learns at once.
CACHE_WORDS, CACHE_WORD_BYTES, LEARNT = 200_000, 64, 1 << 14


#: What a tokenizer file must say for its words to be encoded one by one: texts are normalised character by
#: character (but for composed characters), white space parts words and is dropped, and letters, digits and marks
#: are parted. Fixed values of the file format.
WORD_NORMALISERS = {"NFC", "Lowercase", "Replace"}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer's own description says that its words can be encoded one by one."""
    normalisers = (spec.get("normalizer") or {}).get("normalizers") or []
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split, byte_level = (*steps, {}, {})[:2]
    return (
        {n["type"] for n in normalisers} == WORD_NORMALISERS
        and all(n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normalisers if n["type"] == "Replace")
        and len(steps) == 2 and split.get("type") == "Split" and split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space") and not byte_level.get("use_regex")
        and spec["model"]["type"] == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk", "continuing_subword_prefix", "unk_token"))
        and (suffix := spec["model"].get("end_of_word_suffix")) and all(chr(c) + x in spec["model"]["vocab"] for c in BYTE_LETTERS.values() for x in ("", suffix)) and re.search("[<>'\\s]", suffix)
        and spec.get("truncation") is None and spec.get("padding") is None
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) or re.fullmatch(WordEncoder.PLAIN, t["content"]) for t in spec["added_tokens"])
    )


#: Bytes as the letters that a byte-level step makes of them: themselves where printable, else from 256 up. Fixed values.
_spare = iter(range(256, 512))
BYTE_LETTERS = {b: b if 33 <= b < 127 or 161 <= b < 173 or b >= 174 else next(_spare) for b in range(256)}
PARTED = BYTE_LETTERS | {32: 32}
#: ASCII letters are 1, and marks other than the apostrophe 2.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[[*b'!"#$%&()*+,-./:;=?@[\\]^_`{|}~']] = 2


class WordEncoder(dict):
    """Encodes texts with a tokenizer. If the tokenizer's file says that it treats words alike wherever they
    stand (``splits_words``), it is a mapping of words to their ids that learns those of some texts it does not know, in two
    generations of a bounded size. Words of letters (ASCII and Latin-1), digits and marks are parted here, and go straight to the
    tokenizer's merges, many in one call; an id that ends a part is known by the suffix. Any other tokenizer encodes whole texts."""

    LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
    MARKS = r"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]"
    PLAIN = f"(?:{LETTERS}|[0-9]|{MARKS})*"
    SIMPLE, PARTS = re.compile(PLAIN), re.compile(f"{LETTERS}+|[0-9]|{MARKS}+")
    #: Letters that follow a lower-case or upper-case ASCII letter to make one with it begin with these bytes.
    COMPOSING = (b"\xcc", b"\xcd")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_words(spec)
        self.older: dict[bytes, bytes] = {}
        if self.by_word:
            suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self.added = [t["content"].lower().encode() for t in spec["added_tokens"]]
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = WhitespaceSplit()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, text: bytes) -> list[bytes]:
        """A text's words, with ASCII letters parted from marks and in lower case, where that changes neither what letters compose nor what added tokens there are."""
        low = text.lower()
        if any(x in low for x in (*self.COMPOSING, *self.added)):
            return text.split()
        data = np.frombuffer(low, np.uint8)
        kind = KINDS[data]
        cut = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
        if not len(cut):
            return low.split()
        out = np.full(len(data) + len(cut), 32, np.uint8)
        step = np.zeros(len(data), np.int64)
        step[cut] = 1
        out[np.arange(len(data)) + np.cumsum(step)] = data
        return out.tobytes().split()

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words."""
        out, simple, many, lines = {}, [w for w in words if w.isalpha()], [], []  # of ASCII
        joined = b" ".join(simple).lower().decode()
        many = [1] * len(simple)
        for word in words:
            if word.isalpha():
                continue
            text = word.decode("utf-8", "replace")
            if not self.SIMPLE.fullmatch(text):
                out[word] = array("I", self._encode(text)).tobytes()
                continue
            parts = self.PARTS.findall(text)
            simple.append(word)
            many.append(len(parts))
            lines.append(" ".join(parts).lower())
        if simple:
            # byte by byte: the space between parts is no letter of a byte
            rest = " ".join(lines).encode().decode("latin-1").translate(PARTED)
            ids = np.array(self.merges.encode_batch_fast([f"{joined} {rest}"], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids])[np.cumsum(many) - 1] + 1)).tolist()
            raw = ids.tobytes()
            out |= zip(simple, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        words = [self._words(t) for t in texts]
        new = [w for w in set().union(*words) if w not in self]
        for w in new:
            if w in self.older:
                self[w] = self.older[w]
        new = [w for w in new if w not in self]
        for lo in range(0, len(new), LEARNT):
            self.update(self._learn(new[lo : lo + LEARNT]))
        find = self.__getitem__
        out = [np.frombuffer(b"".join(map(find, w)), "<u4") for w in words]
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                del self[w]
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer and worker process."""
    return WordEncoder(path)


def widths(largest: int) -> tuple[int, ...]:
    """Chunks of eight bits, as many as ids up to ``largest`` need."""
    return (8,) * max(1, -(-largest.bit_length() // 8))


def pack(ids: np.ndarray, chunk_bits: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, continuation bits, rank directory)."""
    levels, rest = [], ids.astype(np.uint32)
    for k, bits in enumerate(chunk_bits):
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(kind)
        rest = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        more = rest > 0
        if k + 1 == len(chunk_bits) and more.any():
            raise ValueError(f"an id needs more than {sum(chunk_bits)} bits")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, np.uint8)
        padded[: len(more)] = more
        counts = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.int64)
        levels.append((chunk, np.packbits(padded, bitorder="little"), (np.cumsum(counts) - counts).astype(np.uint32)))
        rest = rest[more]
    return levels


class Section:
    """An array in a file, of which only the pages that are asked for are read."""

    def __init__(self, file: pa.NativeFile, at: int, size: int, kind: str):
        self.file, self.at, self.size, self.kind = file, at, size, np.dtype(kind)
        self.pages: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.size // self.kind.itemsize

    def view(self, kind: str) -> Section:
        return Section(self.file, self.at, self.size, kind)

    def all(self) -> np.ndarray:
        self.file.seek(self.at)
        return np.frombuffer(self.file.read(self.size), self.kind)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        out, per = np.empty(len(index), self.kind), PAGE // self.kind.itemsize
        page = index // per
        for p in np.unique(page).tolist():
            if p not in self.pages:
                self.file.seek(self.at + p * PAGE)
                self.pages[p] = np.frombuffer(self.file.read(min(PAGE, self.size - p * PAGE)), self.kind)
            own = page == p
            out[own] = self.pages[p][index[own] - p * per]
        return out


class Codes:
    """Random access to the ids of packed levels (arrays or sections)."""

    def __init__(self, levels: list[tuple], chunk_bits: tuple[int, ...]):
        self.levels, self.chunk_bits = [(chunk, bits.view("<u8"), rank) for chunk, bits, rank in levels], chunk_bits

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order."""
        at = np.asarray(at, np.int64)
        out, live, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for (chunk, word, rank), width in zip(self.levels, self.chunk_bits, strict=True):
            if not len(live):
                break
            out[live] |= chunk[at].astype(np.uint32) << np.uint32(shift)
            go = (word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            at, live, shift = at[go], live[go], shift + width
            # rank: the directory's count, whole words since, and the bits below in the last word
            base = rank[at // RANK_BITS].astype(np.int64)
            first, last = at // RANK_BITS * (RANK_BITS // 64), at >> 6
            for j in range(RANK_BITS // 64 - 1):
                w = first + j
                base += np.where(w < last, np.bitwise_count(word[np.minimum(w, last)]), 0)
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            at = base + np.bitwise_count(word[last] & below)
        return out

    def all(self) -> np.ndarray:
        out, live, shift = np.zeros(len(self), np.uint32), np.arange(len(self)), 0
        for (chunk, bits, _), width in zip(self.levels, self.chunk_bits, strict=True):
            out[live] |= chunk.astype(np.uint32) << np.uint32(shift)
            live = live[np.unpackbits(bits.view(np.uint8), count=len(live), bitorder="little").astype(bool)]
            shift += width
        return out


def to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, chunk_bits: tuple[int, ...]) -> bytes:
    arrays = {"doc_ids": doc_ids.astype("<i8"), "nulls": nulls.astype(np.uint8), "ends": np.cumsum(counts).astype("<u8")}
    for k, (chunk, bits, rank) in enumerate(pack(ids, chunk_bits)):
        arrays |= {f"chunks{k}": chunk, f"bits{k}": bits, f"ranks{k}": rank}
    sections, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes()
        sections[name] = [at, len(raw), a.dtype.str]
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + (-len(raw) % 8)
    data = b"".join(body)
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "chunk_bits": list(chunk_bits), "crc32": zlib.crc32(data), "sections": sections}).encode()
    header += b" " * (-len(header) % 8)
    return MAGIC + np.uint64(len(header)).tobytes() + header + data


class Shard:
    """One file: ``doc_ids``, ``nulls``, ``ends`` and random access to ``codes``."""

    def __init__(self, part: dict, header: dict):
        bits = tuple(header["chunk_bits"])
        self.part, self.docs = part, header["docs"]
        self.codes = Codes([(part[f"chunks{k}"], part[f"bits{k}"], part[f"ranks{k}"]) for k in range(len(bits))], bits)

    @classmethod
    def whole(cls, raw) -> Shard:
        """A file that is in memory; its checksum is checked."""
        raw = memoryview(raw)
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(raw[8:16], "<u8")[0])
        header, data = json.loads(bytes(raw[16 : 16 + n])), raw[16 + n :]
        if zlib.crc32(data) != header["crc32"]:
            raise ValueError("the file's checksum does not match")
        return cls({k: np.frombuffer(data[at : at + size], kind) for k, (at, size, kind) in header["sections"].items()}, header)

    @classmethod
    def opened(cls, file: pa.NativeFile) -> Shard:
        """A file of which only what is asked for is read; the checksum, which is of the whole, is not checked."""
        raw = file.read(16)
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(raw[8:16], "<u8")[0])
        header = json.loads(file.read(n))
        return cls({k: Section(file, 16 + n + at, size, kind) for k, (at, size, kind) in header["sections"].items()}, header)

    def _all(self, name: str) -> np.ndarray:
        a = self.part[name]
        return a.all() if isinstance(a, Section) else a

    @property
    def doc_ids(self) -> np.ndarray:
        return self._all("doc_ids")

    @property
    def nulls(self) -> np.ndarray:
        return self._all("nulls").astype(bool)

    @property
    def ends(self) -> np.ndarray:
        return self._all("ends").astype(np.int64)


#: Equal rows that are counted, and those that share one row's text; files that a reading task goes through, at least; hot rows that are broadcast.
HOT, COPIES, FILES_A_TASK, BROADCAST_ROWS = 1024, 64, 16, 20_000
MANIFEST = "file string, part long, seq long, docs long, tokens long, first long, last long"


def _files(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def write_tokens(docs: DataFrame, root: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, chunk_bits: tuple[int, ...] | None = None, shard_tokens: int = 1 << 21) -> DataFrame:
    """Encode and write all documents under ``root`` (a URI all executors reach); returns the manifest.

    ``chunk_bits`` are the widths of the levels; by default eight bits each, as many as the vocabulary needs.
    The manifest has a row a file, in order of ``start``: file, part, seq, docs, tokens, first and last (the
    range of its keys; null if all are null), start.
    """
    if chunk_bits is None:
        chunk_bits = widths(max(end_id, *encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values()))
    rows = counted(docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")))
    # by key and text: rows without a key, or with one that very many share, are dealt to many tasks
    order = ["key", "th", "th2", "turn"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "again").select("key", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files, folder = _files(root)
        encode, seq = encoder(tokenizer).encode, 0
        keys, nulls, counts, ids, size = [], [], [], [], 0
        same, end = np.zeros(0, "<u4"), np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}-{attempt}.dac"
            own, null = np.array(keys, np.int64), np.array(nulls, bool)
            raw = to_bytes(own, null, np.array(counts), np.concatenate(ids), chunk_bits)
            with files.open_output_stream(f"{folder}/data/{name}") as f:
                f.write(raw)
            given = own[~null]
            span = [pa.array([int(x) for x in given[[0, -1]][[k]]] if len(given) else [None], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*[pa.array([x]) for x in (name, part, seq, len(counts), size)], *span], names=["file", "part", "seq", "docs", "tokens", "first", "last"])

        files.create_dir(f"{folder}/data", recursive=True)
        for batch in batches:
            key_nulls = batch.column(0).is_null().to_pylist()
            key_ids, again = batch.column(0).fill_null(0).to_pylist(), batch.column(2).to_pylist()
            for block in blocks(batch.column(1), min(1 << 20, 4 * shard_tokens)):
                raw = block.data.tobytes()
                got = encode([raw[a:b] for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)])
                for k, x in enumerate(got, block.lo):
                    same = x = same if again[k] else x  # the text is that of the row before
                    keys.append(key_ids[k])
                    nulls.append(key_nulls[k])
                    ids += [x, end]
                    counts.append(len(x) + 1)
                    size += len(x) + 1
                if size >= shard_tokens:
                    yield flush()
                    keys, nulls, counts, ids, size, seq = [], [], [], [], 0, seq + 1
        if counts:
            yield flush()

    listed = rows.mapInArrow(run, MANIFEST)
    listed.write.parquet(f"{root}/manifest")
    return read_manifest(docs.sparkSession, root)


def counted(rows: DataFrame) -> DataFrame:
    """key, text, th, th2, turn, again: rows with their place in the order. Of rows of which there are more than ``HOT`` one
    of ``COPIES`` has the text; the others follow it and say so (again)."""
    columns = ["key", "text", "th", "th2", "turn", "again"]
    own = rows.withColumn("th", F.xxhash64("text"))
    rest = (F.lit(0).cast("long").alias("th2"), F.lit(0).cast("long").alias("turn"), F.lit(False).alias("again"))
    found = own.groupBy("key", "th").count().where(F.col("count") > HOT).select(F.col("key").alias("hot_key"), F.col("th").alias("hot_th"))
    hot = Tables(rows.sparkSession, "hot-rows").save(found, "hot")
    n = hot.count()
    if not n:
        return own.select("key", "text", "th", *rest)
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    same = own["key"].eqNullSafe(hot["hot_key"]) & (own["th"] == hot["hot_th"])
    many = own.join(hot, same, "left_semi").groupBy("key", "th", "text").count().withColumn("th2", F.xxhash64(F.lit(1), "text"))
    # a text goes to many tasks before its copies are made
    each = F.lit(COPIES * 1024)
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {COPIES * 1024}"))))
    many = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "th2", "part")
    many = many.withColumn("i", F.explode(F.sequence(F.col("part") * each, F.least((F.col("part") + 1) * each, F.col("count")) - 1)))
    many = many.withColumn("again", F.col("i") % COPIES != 0).withColumn("turn", F.expr(f"i div {COPIES}")).withColumn("text", F.when(~F.col("again"), F.col("text")))
    return own.join(hot, same, "left_anti").select("key", "text", "th", *rest).unionByName(many.select(*columns))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    # files are numbered inside their part; the running total of parts (a row a task that wrote) is the only step on one partition
    before = W.unboundedPreceding, -1
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("own")).select("part", F.coalesce(F.sum("own").over(W.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0))
    return rows.withColumn("inside", inside).join(parts, "part").select(*[f.split()[0] for f in MANIFEST.split(", ")], (F.col("part_start") + F.col("inside")).alias("start"))


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32, in ascending doc_id order within a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(root)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/data/{name}") as f:
                    shard = Shard.whole(f.readall())
                ends, crc = shard.ends, []
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                lo = 0
                while lo < len(ends):
                    hi = max(lo + 1, int(np.searchsorted(ends, begin[lo] + PLACES, "right")))
                    ids = memoryview(shard.codes.get(np.arange(begin[lo], ends[hi - 1])))
                    crc += [zlib.crc32(ids[a:b]) for a, b in zip((begin[lo:hi] - begin[lo]).tolist(), (ends[lo:hi] - begin[lo]).tolist(), strict=True)]
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.nulls), pa.array(base + begin), pa.array(ends - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = read_manifest(spark, root).select("file", "start")
    n = listed.count()
    tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // FILES_A_TASK))))
    return listed.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, root: str, places: DataFrame, *, place: str = "place", cell: int = 1 << 21) -> DataFrame:
    """place and token of each given place of the whole store (0 is the first document's first id), read by
    pages without the rest of a file. Places that do not exist have no row; repeated ones have a row each."""
    listed = read_manifest(spark, root).select("file", "start", (F.col("start") + F.col("tokens")).alias("stop"))
    # a file lies in one or two cells of its size, so places meet their file by an equi-join
    listed = listed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell))))
    asked = places.select(F.col(f"`{place}`").cast("long").alias("place")).withColumn("cell", F.floor(F.col("place") / cell))
    met = asked.join(listed, "cell").where("place >= start and place < stop").select("file", (F.col("place") - F.col("start")).alias("at"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(root)
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            at, given = batch.column(1).to_numpy(), batch.column(2)
            for name in dict.fromkeys(names):
                own = np.flatnonzero(names == name)
                with files.open_input_file(f"{folder}/data/{name}") as f:
                    ids = Shard.opened(f).codes.get(at[own])
                yield pa.RecordBatch.from_arrays([given.take(pa.array(own)), pa.array(ids.astype(np.int64))], names=["place", "token"])

    return met.repartition("file", F.floor(F.col("at") / PAGE)).sortWithinPartitions("file", "at").mapInArrow(run, "place long, token long")


def read_documents(spark: SparkSession, root: str, keys: list[int]) -> DataFrame:
    """doc_id and ids of the documents with the given keys (a short list); other files, and the ids of other
    documents, are not read."""
    wanted = sorted(set(keys))
    listed = read_manifest(spark, root).where(F.exists(F.array(*[F.lit(k).cast("long") for k in wanted]), lambda k: (k >= F.col("first")) & (k <= F.col("last")))).select("file") if wanted else read_manifest(spark, root).select("file").limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{folder}/data/{name}") as f:
                    shard = Shard.opened(f)
                    ends, keys = shard.ends, shard.doc_ids
                    for k in np.flatnonzero(np.isin(keys, wanted) & ~shard.nulls).tolist():
                        ids = shard.codes.get(np.arange(ends[k - 1] if k else 0, ends[k]))
                        yield pa.RecordBatch.from_arrays([pa.array([int(keys[k])]), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return listed.repartition("file").mapInArrow(run, "doc_id long, ids array<long>")
