"""The query of the web-archive operator: a crawl log derived from ``pages``, and its SQL.

Three of four pages give a full response at the time of their id; every page gives a 304 an hour
later. Entity tags are of the body; some 304s have weak tags, tags of another body, dates only, or
no validator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.warc import header_text, resolve_revisits

START, STEP, LATER = 1_700_000_000_000_000, 60_000_000, 3_600_000_000


def crawl_log(pages: DataFrame) -> DataFrame:
    pid, tag = F.col("page_id"), F.substring(F.md5("html"), 1, 16)
    modified = F.concat(F.lit("Mon, "), F.lpad((pid % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 00:00:00 GMT"))
    present = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    full = F.struct(
        F.concat(F.lit("urn:full:"), pid.cast("string")).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("url"),
        (F.lit(START) + pid * F.lit(STEP)).alias("ts"), F.lit(200).alias("status"),
        present(F.create_map(F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("last-modified"), modified, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60"))).alias("headers"),
    )
    etag = F.when(pid % 11 < 2, F.lit(None).cast("string")).when(pid % 7 == 0, F.lit('"other"')).when(pid % 5 == 0, F.concat(F.lit('W/"'), tag, F.lit('"'))).otherwise(F.concat(F.lit('"'), tag, F.lit('"')))
    again = F.struct(
        F.concat(F.lit("urn:again:"), pid.cast("string")).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("url"),
        (F.lit(START + LATER) + pid * F.lit(STEP)).alias("ts"), F.lit(304).alias("status"),
        present(F.create_map(F.lit("etag"), etag, F.lit("last-modified"), F.when(pid % 11 != 0, modified), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("x-seen"), pid.cast("string"))).alias("headers"),
    )
    full_rows = pages.where(F.crc32(pid.cast("string").cast("binary")) % 4 != 0).select(full.alias("r"), "html")
    again_rows = pages.select(again.alias("r"), F.lit(None).cast("string").alias("html"))
    return full_rows.unionByName(again_rows).select("r.*", F.col("html").alias("body"))


def resolved_revisits(pages: DataFrame) -> DataFrame:
    out = resolve_revisits(crawl_log(pages))
    return out.select("record_id", "url", "canonical", "ts", "refers_to", "outcome", "status", header_text(F.col("headers")).alias("headers"), F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_chars"))


SQL = r"""
WITH log AS (
  SELECT page_id, url, html, substr(md5(html), 1, 16) AS tag,
         'Mon, ' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ' Jan 2024 00:00:00 GMT' AS modified,
         regexp_replace(trim(url), '#.*$', '') AS bare FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^[^@]*@|:[0-9]*$', '', 'g'), '^www[.]', '') AS host,
         regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid)(=.*)?$'))) AS kept FROM log
), keyed AS (
  SELECT *, CASE WHEN host = '' THEN bare ELSE 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM parts
), crc AS (
  SELECT page_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(CAST(page_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(page_id AS VARCHAR), i, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda x: 0::UBIGINT)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS c FROM pages
), full_rows AS (
  SELECT k.*, 1700000000000000 + k.page_id * 60000000 AS ts FROM keyed k JOIN (SELECT DISTINCT page_id FROM crc WHERE xor(c, 4294967295::UBIGINT) % 4 <> 0) USING (page_id)
), again AS (
  SELECT *, 1700003600000000 + page_id * 60000000 AS ts,
         CASE WHEN page_id % 11 < 2 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 5 = 0 THEN 'W/"' || tag || '"' ELSE '"' || tag || '"' END AS etag,
         CASE WHEN page_id % 11 <> 0 THEN modified END AS own_modified FROM keyed
), found AS (
  SELECT a.*, f.page_id AS f_id, '"' || f.tag || '"' AS f_etag, f.modified AS f_modified, f.html AS f_html
  FROM again a ASOF LEFT JOIN full_rows f ON a.canonical = f.canonical AND a.ts > f.ts
), judged AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'no_earlier'
     WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_etag THEN 'resolved' ELSE 'mismatch' END
     WHEN own_modified IS NOT NULL THEN CASE WHEN own_modified = f_modified THEN 'resolved' ELSE 'mismatch' END
     ELSE 'no_validator' END AS outcome FROM found
)
SELECT 'urn:again:' || page_id AS record_id, url, canonical, ts, CASE WHEN f_id IS NOT NULL THEN 'urn:full:' || f_id END AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END AS status,
  CASE WHEN outcome = 'resolved' THEN
    concat_ws(chr(10), 'cache-control: max-age=120', 'content-length: ' || length(f_html), 'content-type: text/html', 'etag: ' || coalesce(etag, f_etag), 'last-modified: ' || coalesce(own_modified, f_modified), 'x-seen: ' || page_id)
  ELSE concat_ws(chr(10), 'cache-control: max-age=120', 'content-length: 0', 'etag: ' || etag, 'last-modified: ' || own_modified, 'x-seen: ' || page_id) END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(f_html) END AS body_md5, CASE WHEN outcome = 'resolved' THEN CAST(length(f_html) AS BIGINT) END AS body_chars
FROM judged
"""
