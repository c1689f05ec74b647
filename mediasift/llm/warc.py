"""Web archive records: reading, writing, and resolving not-modified revisits.

A revisit that a server answered with 304 has no body. It is resolved against the latest earlier
full response with the same canonical URL: entity tags are compared weakly, else the last-modified
dates; if neither side can be compared, or they differ, the revisit keeps its own headers and no
body. A resolved revisit has the stored response's body and its headers, updated by those of the
304 that may be merged.

The answer depends on a revisit's URL and time only, so the as-of join runs on distinct pairs of
those; a record id is never used to find a revisit again. Times are cut into periods, so a window
covers one URL in one period; the last full response of each URL and period is carried into later
periods by a window over a row per URL and period. A URL with a third of all records is thereby
split over its periods. Bodies join once, by URL, time and id of the full response; the join's sides are
plain shuffles, so a response that very many revisits refer to can be split.

Every revisit gives one row, however often its id occurs; null ids are ids like others. A null URL or
time has no earlier response. Full responses at the same URL and time: the largest record id counts
(a null one last); those that share the id as well, repeated rows included, count as one, the one with the
largest hash of body and headers. A full response at the revisit's own time is not earlier. Header
names are given in lower case; of names that differ in case only the first counts. An empty body is
a body, of any length. Columns other than those named are dropped, so clashing names cannot matter; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from mediasift.llm.shared import Tables

#: Header fields of a 304 that do not replace the stored ones (fixed values: RFC 9110 and 9111).
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
]
#: Query parameters that do not tell pages apart.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid)(=.*)?$"
PERIOD = 3_600 * 1_000_000
#: Up to so many repeated (URL, time, id) of full responses are broadcast to find their rows; beyond, rows are shuffled.
BROADCAST_ROWS = 100_000

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("ts", T.LongType()),
    T.StructField("status", T.IntegerType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.BinaryType()),
])


def canonical_url(url: Column) -> Column:
    """Scheme https and host in lower case without www., port, user or fragment; tracking parameters
    dropped and the rest sorted; no trailing slash but the root's."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^[^@]*@|:[0-9]*$", "")
    host = F.regexp_replace(host, "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    text = F.concat(F.lit("https://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host == "", bare).otherwise(text)


def as_of(left: DataFrame, right: DataFrame, period: int = PERIOD) -> DataFrame:
    """Distinct (key, ts) of ``left`` with ``found``: ts and id of the latest ``right`` row (key, ts, id) of
    the key strictly before; without one there is no row."""
    ask = left.select("key", "ts", F.lit(None).cast(right.schema["id"].dataType).alias("id"), F.lit(False).alias("full"))
    rows = ask.unionByName(right.select("key", "ts", "id", F.lit(True).alias("full")))
    rows = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).groupBy("key", "ts", "full").agg(F.max("id").alias("id"))
    rows = rows.withColumn("p", F.floor(F.col("ts") / F.lit(period)))
    own = F.when(F.col("full"), F.struct("ts", "id"))
    last = rows.groupBy("key", "p").agg(F.max(own).alias("last"))
    carried = last.select("key", "p", F.max("last").over(W.partitionBy("key").orderBy("p").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = rows.withColumn("inside", F.max(own).over(W.partitionBy("key", "p").orderBy("ts").rangeBetween(W.unboundedPreceding, -1))).where("not full")
    joined = inside.join(carried.where("carried is not null"), ["key", "p"], "left")
    return joined.select("key", "ts", F.coalesce("inside", "carried").alias("found")).where("found is not null")


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of equal ones the first stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    fixed = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))
    return F.when(F.exists(F.map_keys(headers), lambda k: k != F.lower(k)), fixed).otherwise(headers)


def one_each(full: DataFrame) -> DataFrame:
    """Full responses (f_key, f_ts, f_id, stored, stored_body), one for each of the first three.

    Repeats are counted without bodies; only rows that have any are aggregated."""
    by = ["f_key", "f_ts", "f_id"]
    counted = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"r_{c}") for c in by])
    repeated = Tables(full.sparkSession, "warc").save(counted, "repeated")
    n = repeated.count()
    if not n:
        return full
    if n <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    same = (F.col("f_key") == F.col("r_f_key")) & (F.col("f_ts") == F.col("r_f_ts")) & F.col("f_id").eqNullSafe(F.col("r_f_id"))
    order = F.struct(F.xxhash64("stored_body"), F.xxhash64(F.sort_array(F.map_entries("stored"))))
    best = full.join(repeated, same, "left_semi").groupBy(*by).agg(F.max_by(F.struct("stored", "stored_body"), order).alias("x"))
    return full.join(repeated, same, "left_anti").unionByName(best.select(*by, "x.stored", "x.stored_body"))


def validators_match(stored: Column, fresh: Column) -> Column:
    """True or false where both header maps can be compared, else null."""
    weak = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    etags = F.when(stored["etag"].isNotNull() & fresh["etag"].isNotNull(), weak(stored) == weak(fresh))
    dates = F.when(stored["last-modified"].isNotNull() & fresh["last-modified"].isNotNull(), F.trim(stored["last-modified"]) == F.trim(fresh["last-modified"]))
    return F.coalesce(etags, dates)


def merge_headers(stored: Column, fresh: Column) -> Column:
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, period: int = PERIOD) -> DataFrame:
    """A row per revisit: record_id, url, canonical, ts, refers_to, outcome, status, headers, body.

    ``records`` has the columns of RECORD (body of any type). Outcome is ``resolved``,
    ``mismatch``, ``no_validator`` or ``no_earlier``.
    """
    keyed = records.select(*RECORD.names).withColumn("canonical", canonical_url(F.col("url"))).withColumn("headers", lower_names(F.col("headers")))
    revisits = keyed.where("warc_type = 'revisit' and status = 304").drop("body")
    full = keyed.where("warc_type = 'response' and status = 200 and canonical is not null and ts is not null")
    narrow = [F.col("canonical").alias("key"), "ts", F.col("record_id").alias("id")]
    found = as_of(revisits.select(*narrow), full.select(*narrow), period).select(F.col("key").alias("r_key"), F.col("ts").alias("r_ts"), F.col("found.ts").alias("found_ts"), F.col("found.id").alias("found_id"))
    stored = one_each(full.select(F.col("canonical").alias("f_key"), F.col("ts").alias("f_ts"), F.col("record_id").alias("f_id"), F.col("headers").alias("stored"), F.col("body").alias("stored_body")))
    joined = revisits.join(found, (F.col("canonical") == F.col("r_key")) & (F.col("ts") == F.col("r_ts")), "left")
    joined = joined.join(stored, (F.col("canonical") == F.col("f_key")) & (F.col("found_ts") == F.col("f_ts")) & F.col("found_id").eqNullSafe(F.col("f_id")), "left")
    empty = F.create_map().cast("map<string,string>")
    match = validators_match(F.coalesce("stored", empty), F.coalesce("headers", empty))
    outcome = F.when(F.col("found_ts").isNull(), "no_earlier").when(match.isNull(), "no_validator").when(match, "resolved").otherwise("mismatch")
    done = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "canonical", "ts", F.col("found_id").alias("refers_to"), "outcome",
        F.when(done, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(done, merge_headers(F.coalesce("stored", empty), F.coalesce("headers", empty))).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("stored_body")).alias("body"),
    )


def header_text(headers: Column) -> Column:
    """One ``name: value`` line per field, sorted."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


# --- record files -------------------------------------------------------------------------------


LEAST_READ = 1 << 20
WARC_LINE = re.compile(rb"(?:^|\n)(?=WARC/\d)")


def _fields(lines: bytes) -> dict[str, str]:
    """Fields of a header block in lower case; values of repeated fields are joined by commas."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", lines).split(b"\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def inflate(raw: bytes) -> Iterator[bytes | None]:
    """The contents of a gzip file in pieces, or the bytes themselves. None stands for a damaged part;
    reading goes on with the next member."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while at < len(raw):
        if raw[at : at + 3] == b"\x1f\x8b\x08":
            member, fed = zlib.decompressobj(31), at
            try:
                while not member.eof and fed < len(raw):
                    part = member.unconsumed_tail or raw[fed : fed + LEAST_READ]
                    fed += 0 if member.unconsumed_tail else len(part)
                    yield member.decompress(part, 4 * LEAST_READ)
                while not member.eof and member.unconsumed_tail:
                    yield member.decompress(member.unconsumed_tail, 4 * LEAST_READ)
                if not member.eof:
                    yield member.flush()
                if member.eof:
                    at = fed - len(member.unused_data)
                    continue
            except zlib.error:
                pass
        yield None
        after = raw.find(b"\x1f\x8b\x08", at + 1)
        at = after if after >= 0 else len(raw)


def parse_records(raw: bytes) -> Iterator[dict]:
    """The records of one file. What cannot be read gives a row with an ``error`` in its place, and reading
    goes on at the next record."""
    held, need = bytearray(), 0  # what is not yet read, and how much of it the next record takes at least

    def broken(why: str) -> dict:
        return dict.fromkeys(RECORD.names) | {"error": why}

    def read(last: bool) -> Iterator[dict]:
        nonlocal need
        at, size, need = 0, len(held), 0
        while at < size:
            if held[at] in b"\r\n":
                at += 1
                continue
            if not held.startswith(b"WARC/", at):
                if size - at < 5 and not last:
                    break
                yield broken("no record begins here")
                m = WARC_LINE.search(held, at + 1)
                at = m.end() if m else size
                continue
            end = held.find(b"\r\n\r\n", at)
            following = WARC_LINE.search(held, at + 1, end if end >= 0 else size)
            if following:  # the next record begins before this one's header ends
                yield broken("the header does not end")
                at = following.end()
                continue
            if end < 0:
                if last:
                    yield broken("the header does not end")
                    at = size
                break
            fields = _fields(held[at:end])
            length = fields.get("content-length", "")
            if not length.isascii() or not length.isdigit():
                yield broken("no length")
                m = WARC_LINE.search(held, end)
                at = m.end() if m else size
                continue
            begin, stop = end + 4, end + 4 + int(length)
            if size < stop + 4 and not last:
                need = stop + 4 - at
                break
            tail = held[stop : stop + 4]
            if stop > size or (tail and not tail.startswith((b"\r\n", b"WARC"))):
                yield broken("the length is wrong or the record is cut")
                m = WARC_LINE.search(held, end)
                at = m.end() if m else size
                continue
            yield _record(fields, bytes(held[begin:stop]))
            at = stop
        del held[:at]

    for part in inflate(raw):
        if part is None:
            yield from read(True)
            held.clear()
            yield broken("a damaged part of the file")
        else:
            held.extend(part)
            if len(held) >= need:
                yield from read(False)
    yield from read(True)


def _record(fields: dict[str, str], block: bytes) -> dict:
    status, headers, body = None, {}, block
    if block.startswith(b"HTTP/"):
        head, _, body = block.partition(b"\r\n\r\n")
        line, _, rest = head.partition(b"\n")
        code = line.split(maxsplit=2)[1:2]
        status, headers = int(code[0]) if code and code[0].isdigit() else None, _fields(rest)
    when = pd.to_datetime(fields.get("warc-date"), utc=True, errors="coerce")
    return {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "ts": None if pd.isna(when) else int(when.value // 1000), "status": status, "headers": headers, "body": body, "error": None}


def read_warc(files: DataFrame) -> DataFrame:
    """Records (columns of RECORD, and ``error``) of files with a binary ``content``, as Spark's binaryFile
    source gives them; a null content has none. Damaged parts give rows with an error and nulls. Files
    should be split as crawlers do, at about 1 GB."""
    names = [*RECORD.names, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows, size = [], 0
                for r in parse_records(bytes(raw)) if raw is not None else ():
                    rows.append(r)
                    size += len(r["body"] or b"")
                    if len(rows) == 500 or size > 16 * LEAST_READ:
                        yield pd.DataFrame(rows, columns=names).astype({"ts": "Int64", "status": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"ts": "Int64", "status": "Int64"})

    return files.select("content").mapInPandas(run, T.StructType([*RECORD.fields, T.StructField("error", T.StringType())]))


def record_bytes(record: dict) -> bytes:
    """One record as bytes; ``parse_records`` gives the record back."""
    reason = {200: "OK", 304: "Not Modified"}.get(record["status"], "")
    http = f"HTTP/1.1 {record['status']} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in sorted((record["headers"] or {}).items())) + "\r\n"
    block = http.encode() + bytes(record["body"] or b"")
    date = pd.Timestamp(record["ts"] * 1000, tz="UTC").isoformat().replace("+00:00", "Z")
    head = f"WARC/1.1\r\nWARC-Type: {record['warc_type']}\r\nWARC-Record-ID: {record['record_id']}\r\nWARC-Target-URI: {record['url']}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"
