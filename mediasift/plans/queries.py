"""Registered queries of the media library, each beside the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.codecs import decode_image
from mediasift.functions import media, terms, text, vectors
from mediasift.functions import paths as P
from mediasift.operators import encode as en
from mediasift.operators import evaluate as ev
from mediasift.operators import images as im
from mediasift.operators import index as ix
from mediasift.operators import listing_filters as lf
from mediasift.operators import search as sr
from mediasift.plans.views import rounded, view, with_views
from mediasift.sources.files import place_of
from mediasift.sources.listing import Library
from mediasift.sources.results import write_results
from mediasift.sources.shared import shared_dir
from mediasift.sources.store import IndexStore, migrate
from mediasift.sources.walk import list_library

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None, views: str = ""):
    def add(f):
        REGISTRY[f.__name__] = (f, with_views(views, sql) if sql and views else sql)
        return f

    return add


def likes(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_EXT = "regexp_matches(regexp_replace(filepath, '^.*/', ''), '(?i)^.+\\.(" + "|".join(P.IMAGE_EXTENSIONS) + ")$')"
_DIR = "regexp_replace(filepath, '/[^/]*$', '')"
_NAMES = "|".join(d.replace(".", "\\.") for d in P.EXCLUDED_DIRS)
_EXCLUDED = f"regexp_matches({_DIR}, '^.+/({_NAMES})(/.+)?$')"
_HIDDEN = "len(list_filter(string_split(substr(filepath, 6), '/'), lambda c: starts_with(c, '.'))) > 0"
_DOT = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_ZERO = "(SELECT vector FROM items WHERE vec_id = (SELECT min(vec_id) FROM items))"
_SCORE = f"round({_DOT.format('vector', _ZERO)}, 6) + 0.0"
_NOT_EXCLUDED = f"NOT regexp_matches(filepath, '^.+/({_NAMES})(/.+)?$')"


def first_vector(items: DataFrame) -> tuple[str, list[float]]:
    """Path and vector of the item with the smallest id."""
    r = items.agg(F.min_by(F.struct("filepath", "vector"), "vec_id")).first()[0]
    return r[0], list(r[1])


# --- listing ------------------------------------------------------------------------------------


@register(f"SELECT doc_id, filepath FROM paths WHERE {_EXT}", "paths")
def list_filter_ext(spark, d):
    return lf.with_extension(view(spark, d, "paths"))


@register(f"SELECT doc_id, filepath FROM paths WHERE NOT {_EXCLUDED}", "paths")
def list_filter_excluded(spark, d):
    return lf.not_excluded(view(spark, d, "paths"))


@register(f"SELECT doc_id, filepath FROM paths WHERE NOT ({_HIDDEN})", "paths")
def list_filter_hidden(spark, d):
    return lf.not_hidden(view(spark, d, "paths"), "/lib")


_KNOWN = likes(P.IMAGE_EXTENSIONS + [e.upper() for e in P.IMAGE_EXTENSIONS])
_STEM = "regexp_replace(filepath, '\\.[^./]*$', '')"
_SHADOWED = f"lower(regexp_extract(filepath, '\\.([^./]*)$', 1)) IN ({likes(P.RAW_EXTENSIONS)}) AND {_STEM} IN (SELECT {_STEM} FROM paths WHERE regexp_extract(filepath, '\\.([^./]*)$', 1) IN ({_KNOWN}))"


@register(f"SELECT doc_id, filepath FROM paths WHERE NOT ({_SHADOWED})", "paths")
def raw_sibling_antijoin(spark, d):
    return lf.without_shadowed_raw(view(spark, d, "paths"))


@register(f"SELECT count(*) AS files FROM paths WHERE {_EXT} AND NOT {_EXCLUDED} AND NOT ({_HIDDEN})", "paths")
def list_count(spark, d):
    return lf.library_view(view(spark, d, "paths"), "/lib").agg(F.count(F.lit(1)).alias("files"))


@register("SELECT doc_id, filepath, lower(regexp_extract(filepath, '(?:^|/)\\.*[^/.][^/]*\\.([^/.]*)$', 1)) AS ext FROM paths", "paths")
def file_extension(spark, d):
    return view(spark, d, "paths").withColumn("ext", P.extension(F.col("filepath")))


_LISTED = f"SELECT filepath, CAST(strlen(text) AS BIGINT) AS size FROM paths JOIN documents USING (doc_id) WHERE text IS NOT NULL AND {_EXT} AND NOT {_EXCLUDED} AND NOT ({_HIDDEN})"


def _written_library(spark, d) -> str:
    """The documents as files of the paths' names, written by tasks to the shared folder."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = view(spark, d, "paths").join(view(spark, d, "documents").select("doc_id", "text"), "doc_id").where("text is not null").select("filepath", "text")

    def write(batches):
        place = place_of(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place.files.create_dir(place.inner(root + path).rsplit("/", 1)[0], recursive=True)
                with place.files.open_output_stream(place.inner(root + path)) as out:
                    out.write(content.encode())
            yield batch.select([0])

    rows.mapInArrow(write, "filepath string").write.format("noop").mode("overwrite").save()
    return root


def _below(files: DataFrame, root: str) -> DataFrame:
    return files.select(F.substring("filepath", len(root) + 1, 1 << 20).alias("filepath"), "size")


@register(_LISTED, "paths")
def library_listing(spark, d):
    root = _written_library(spark, d)
    return _below(list_library(spark, root), root)


@register(_LISTED, "paths")
def library_stream(spark, d):
    """The same files, as a stream finds them."""
    root = _written_library(spark, d).removeprefix("file://")
    out = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    spark.dataSource.register(Library)
    stream = spark.readStream.format("library").options(root=root, lag="0").load()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/files").awaitTermination()
    return _below(spark.read.parquet(f"{out}/files"), root)


# --- index --------------------------------------------------------------------------------------

_STATE = """CASE WHEN l.filepath IS NULL THEN CASE WHEN starts_with(translate(i.filepath, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/lib/') THEN 'gone' ELSE 'out_of_scope' END
 WHEN i.filepath IS NULL THEN 'new' WHEN l.modified_at = i.modified_at AND l.size = i.size THEN 'unchanged' ELSE 'changed' END"""
_DIFF = f"SELECT coalesce(l.filepath, i.filepath) AS filepath, {_STATE} AS state FROM listing l FULL OUTER JOIN idx i ON l.filepath = i.filepath"
_DONORS = "SELECT hash, size, min(filepath) AS donor, arg_min(vector, filepath) AS donated FROM idx WHERE deleted IS NULL AND hash IS NOT NULL GROUP BY hash, size"


@register("SELECT filepath FROM idx WHERE deleted IS NULL AND starts_with(lower(filepath), '/lib/en/')", "idx")
def prefix_scan(spark, d):
    return ix.scan(view(spark, d, "idx"), "/LIB/en").select("filepath")


@register("SELECT filepath, size, deleted FROM idx WHERE filepath IN (SELECT filepath FROM listing)", "listing idx")
def index_lookup(spark, d):
    return ix.lookup(view(spark, d, "idx"), view(spark, d, "listing")).select("filepath", "size", "deleted")


@register(_DIFF, "listing idx")
def index_diff(spark, d):
    return ix.diff(view(spark, d, "listing"), view(spark, d, "idx"), "/lib")


@register("SELECT filepath, CASE WHEN starts_with(filepath, '/lib/') AND filepath NOT IN (SELECT filepath FROM listing) THEN true ELSE deleted END AS deleted FROM idx", "listing idx")
def index_sweep(spark, d):
    return ix.sweep(view(spark, d, "idx"), view(spark, d, "listing"), "/lib").select("filepath", "deleted")


def _todo(spark, d):
    listing, index = view(spark, d, "listing"), view(spark, d, "idx")
    return listing.join(ix.diff(listing, index, "/lib").where("state in ('new', 'changed')"), "filepath", "left_semi"), index


@register(f"SELECT filepath, donor FROM listing LEFT JOIN ({_DONORS}) USING (hash, size) WHERE filepath IN (SELECT filepath FROM ({_DIFF}) WHERE state IN ('new', 'changed'))", "listing idx")
def rename_reuse(spark, d):
    todo, index = _todo(spark, d)
    return ix.reuse(todo, index).select("filepath", "donor")


_FLOATS = "[(('0x' || substr(hash, 1, 4))::INT / 65536.0)::FLOAT]"


def _hash_vector(rows: DataFrame) -> DataFrame:
    """A stand-in encoder: one number from the content's hash."""
    return rows.withColumn("vector", F.array((F.conv(F.substring("hash", 1, 4), 16, 10).cast("double") / 65536.0).cast("float")))


_ROW = "filepath, modified_at, size, hash, deleted, round(CAST(vector[1] AS DOUBLE), 6) AS v0"


def _index_rows(index: DataFrame) -> DataFrame:
    return index.select("filepath", "modified_at", "size", "hash", "deleted", F.round(F.col("vector")[0].cast("double"), 6).alias("v0"))


@register(
    f"""SELECT {_ROW} FROM idx WHERE filepath NOT IN (SELECT filepath FROM ({_DIFF}) WHERE state IN ('new', 'changed'))
 UNION ALL SELECT filepath, modified_at, size, hash, NULL, round(CAST({_FLOATS}[1] AS DOUBLE), 6) FROM listing WHERE filepath IN (SELECT filepath FROM ({_DIFF}) WHERE state IN ('new', 'changed'))""",
    "listing idx",
)
def index_upsert(spark, d):
    todo, index = _todo(spark, d)
    return _index_rows(ix.upsert(index, _hash_vector(todo)))


@register(
    f"""SELECT filepath, modified_at, size, hash, NULL AS deleted, round(CAST(coalesce(donated, {_FLOATS})[1] AS DOUBLE), 6) AS v0 FROM listing LEFT JOIN ({_DONORS}) USING (hash, size)
 WHERE filepath IN (SELECT filepath FROM ({_DIFF}) WHERE state IN ('new', 'changed'))
 UNION ALL SELECT filepath, modified_at, size, hash, CASE state WHEN 'gone' THEN true WHEN 'unchanged' THEN NULL ELSE deleted END, round(CAST(vector[1] AS DOUBLE), 6)
 FROM idx JOIN ({_DIFF}) USING (filepath) WHERE state NOT IN ('new', 'changed')""",
    "listing idx",
)
def index_apply(spark, d):
    return _index_rows(ix.refresh(view(spark, d, "listing"), view(spark, d, "idx"), "/lib", lambda rows: rows, _hash_vector))


_CHANGED = f"""SELECT filepath, 'row' AS kind, CAST(NULL AS BOOLEAN) AS deleted FROM ({_DIFF}) WHERE state IN ('new', 'changed')
 UNION ALL SELECT filepath, 'mark', CASE state WHEN 'gone' THEN true END FROM ({_DIFF}) JOIN idx USING (filepath) WHERE state = 'gone' AND deleted IS NULL OR state = 'unchanged' AND deleted"""


def _delta(spark, d):
    """The changes of a refresh whose files' hashes are those of the listing."""
    listing, index = view(spark, d, "listing"), view(spark, d, "idx")
    hashes = listing.select("filepath", "hash")
    return index, ix.delta(listing.drop("hash"), index, "/lib", lambda rows: rows.join(hashes, "filepath"), _hash_vector)


@register(_CHANGED, "listing idx")
def index_delta(spark, d):
    _, (rows, marks, _) = _delta(spark, d)
    return rows.select("filepath", F.lit("row").alias("kind"), "deleted").unionByName(marks.select("filepath", F.lit("mark").alias("kind"), "deleted"))


@register(
    f"""SELECT count(*) FILTER (WHERE state IN ('new', 'changed', 'unchanged')) AS visited, count(*) FILTER (WHERE state = 'unchanged') AS unchanged, count(*) FILTER (WHERE state = 'new') AS new,
 count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'gone' AND i.deleted IS NULL) AS gone, count(*) FILTER (WHERE state = 'unchanged' AND i.deleted) AS restored,
 (SELECT count(*) FROM ({_CHANGED}) WHERE kind = 'row') AS written, (SELECT count(*) FROM ({_CHANGED}) WHERE kind = 'mark') AS marked FROM ({_DIFF}) s LEFT JOIN idx i ON i.filepath = s.filepath""",
    "listing idx",
)
def index_refresh_counts(spark, d):
    _, (_, _, counts) = _delta(spark, d)
    names = ["visited", "unchanged", "new", "changed", "gone", "restored", "written", "marked"]
    return spark.range(1).select(*[F.lit(counts[n]).cast("long").alias(n) for n in names])


@register(
    f"""SELECT * FROM (SELECT filepath, modified_at, size, hash, NULL AS deleted, round(CAST(coalesce(donated, {_FLOATS})[1] AS DOUBLE), 6) AS v0 FROM listing LEFT JOIN ({_DONORS}) USING (hash, size)
 WHERE filepath IN (SELECT filepath FROM ({_DIFF}) WHERE state IN ('new', 'changed'))
 UNION ALL SELECT filepath, modified_at, size, hash, CASE state WHEN 'gone' THEN true WHEN 'unchanged' THEN NULL ELSE deleted END, round(CAST(vector[1] AS DOUBLE), 6)
 FROM idx JOIN ({_DIFF}) USING (filepath) WHERE state NOT IN ('new', 'changed')) WHERE starts_with(lower(filepath), '/lib/en/')""",
    "listing idx",
)
def index_stored_scope(spark, d):
    """The changes added to a stored index, which is then read below one directory."""
    index, (rows, marks, _) = _delta(spark, d)
    store = IndexStore(spark, f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}")
    store.write(index)
    store.add(rows, marks=marks)
    return _index_rows(store.read(scope="/LIB/en"))


@register("SELECT hash, size, count(*) AS files, min(filepath) AS first, max(filepath) AS last FROM listing WHERE hash IS NOT NULL GROUP BY hash, size HAVING count(*) > 1", "listing")
def duplicate_groups(spark, d):
    return ix.duplicates(view(spark, d, "listing"))


@register("SELECT filepath, modified_at, size, CAST(NULL AS VARCHAR) AS hash, deleted FROM idx", "idx")
def index_migrate(spark, d):
    return migrate(view(spark, d, "idx").drop("hash"), 3).drop("vector")


@register()
def stream_upsert(spark, d):
    """The listing as a stream, upserted into an empty stored index; rows only."""
    from mediasift.streaming.upsert import stream_upsert as start

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    view(spark, d, "listing").write.parquet(f"{root}/input")
    stream = spark.readStream.schema("filepath string, modified_at double, size long, hash string").parquet(f"{root}/input")
    store = IndexStore(spark, f"{root}/index")
    start(stream, store, f"{root}/checkpoint", _hash_vector, scope="/lib").awaitTermination()
    return _index_rows(store.read())


# --- fingerprints, images, text -----------------------------------------------------------------


@register("SELECT doc_id, sha256(encode(substr(text, 1, 1048576)) || CASE WHEN strlen(text) > 1024 THEN encode(text)[-1024:] ELSE ''::BLOB END) AS hash FROM documents")
def content_fingerprint(spark, d):
    return view(spark, d, "documents").select("doc_id", media.fingerprint(F.encode("text", "utf-8")).alias("hash"))


@register(f"SELECT image_id, width, height FROM image_dims WHERE width * height <= {media.LEAST_CAP}", "image_dims")
def pixel_cap_filter(spark, d):
    return im.pixel_cap(view(spark, d, "image_dims"), media.LEAST_CAP).select("image_id", "width", "height")


_GREY = "list_transform(embedding, lambda x: CAST(floor(128 + 127 * CAST(x AS DOUBLE)) AS BIGINT))"
#: Width and height 8, 24 bits a pixel, rows from the bottom, as a bitmap's first 54 bytes in hexadecimal.
BITMAP_HEAD = "424df60000000000000036000000" + "28000000080000000800000001001800000000000000000000000000000000000000000000000000"[:80]


def _pixels(files: pd.Series) -> pd.DataFrame:
    found = [decode_image(bytes(x)) for x in files]
    return pd.DataFrame({"height": [x.shape[0] for x in found], "width": [x.shape[1] for x in found], "total": [int(x.sum()) for x in found], "first": [int(x[0, 0, 0]) for x in found], "last": [int(x[-1, -1, 2]) for x in found]})


@register(
    f"""SELECT vec_id, kind, 8 AS height, 8 AS width, CAST(3 * list_sum(g) AS BIGINT) AS total, CASE kind WHEN 'pgm' THEN g[1] ELSE g[57] END AS first, CASE kind WHEN 'pgm' THEN g[64] ELSE g[8] END AS last
 FROM (SELECT vec_id, {_GREY} AS g FROM embeddings), (VALUES ('pgm'), ('bmp')) k(kind)"""
)
def image_pixels(spark, d):
    """Images of 8 x 8 grey values made of the vectors, as a greymap and as a bitmap, decoded."""
    two = lambda x: F.lpad(F.hex(F.floor(F.lit(128) + F.lit(127) * x.cast("double"))), 2, "0")
    grey = F.array_join(F.transform("embedding", two), "")
    colour = F.array_join(F.transform("embedding", lambda x: F.repeat(two(x), 3)), "")
    head = b"P5 8 8 255\n".hex()
    rows = view(spark, d, "embeddings").select("vec_id", F.explode(F.create_map(F.lit("pgm"), F.unhex(F.concat(F.lit(head), grey)), F.lit("bmp"), F.unhex(F.concat(F.lit(BITMAP_HEAD), colour)))).alias("kind", "file"))
    pixels = F.pandas_udf(_pixels, "struct<height: int, width: int, total: long, first: long, last: long>")
    return rows.select("vec_id", "kind", pixels("file").alias("p")).select("vec_id", "kind", "p.*")


_BOMB = "coalesce(TRY_CAST(regexp_extract(error, 'Image size \\((\\d+) pixels\\)', 1) AS BIGINT), 0)"
_REASON = f"CASE WHEN width * height > {media.LEAST_CAP} THEN 'too_large' WHEN {_BOMB} > 0 THEN 'bomb' WHEN starts_with(error, 'out of memory') THEN 'out_of_memory' WHEN starts_with(error, 'cannot identify') THEN 'unreadable' WHEN error IS NOT NULL THEN 'other' END"


_MESSAGE = f"CASE WHEN width * height > {media.LEAST_CAP} THEN printf('%.0f', width * height / 1e6) || ' MP is above the cap' WHEN {_BOMB} > 0 THEN printf('%.0f', {_BOMB} / 1e6) || ' MP is above the cap' ELSE error END"


@register(f"SELECT image_id, reason, message FROM (SELECT *, {_REASON} AS reason, {_MESSAGE} AS message FROM image_dims) WHERE reason IS NOT NULL", "image_dims")
def skip_messages(spark, d):
    return im.quarantine(view(spark, d, "image_dims"), media.LEAST_CAP).where("reason is not null").select("image_id", "reason", "message")


@register(f"SELECT reason, count(*) AS files, max(width * height) AS most_pixels FROM (SELECT *, {_REASON} AS reason FROM image_dims) WHERE reason IS NOT NULL GROUP BY reason", "image_dims")
def skip_report(spark, d):
    bad = im.quarantine(view(spark, d, "image_dims"), media.LEAST_CAP).where("reason is not null")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.max(F.col("width") * F.col("height")).alias("most_pixels"))


@register(f"SELECT image_id, {_BOMB} AS pixels FROM image_dims", "image_dims")
def bomb_pixels_parse(spark, d):
    return view(spark, d, "image_dims").select("image_id", F.coalesce(media.bomb_pixels(F.col("error")), F.lit(0)).alias("pixels"))


@register(
    """SELECT image_id, new_width, new_height, CAST(round_even((new_width - 256) / 2.0, 0) AS BIGINT) AS crop_left, CAST(round_even((new_height - 256) / 2.0, 0) AS BIGINT) AS crop_top FROM (
 SELECT image_id, CASE WHEN width <= height THEN 256 ELSE CAST(floor(width * 256 / height) AS BIGINT) END AS new_width, CASE WHEN width <= height THEN CAST(floor(height * 256 / width) AS BIGINT) ELSE 256 END AS new_height FROM image_dims)""",
    "image_dims",
)
def preprocess_geometry(spark, d):
    w, h = media.resized(F.col("width"), F.col("height"))
    out = view(spark, d, "image_dims").select("image_id", w.alias("new_width"), h.alias("new_height"))
    return out.withColumn("crop_left", media.crop_offset(F.col("new_width"))).withColumn("crop_top", media.crop_offset(F.col("new_height")))


@register("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM documents")
def text_clean(spark, d):
    return view(spark, d, "documents").select("doc_id", text.clean(F.col("text"), unescape=False).alias("cleaned"))


_TOKENS = "regexp_extract_all(text, '" + text.TOKEN_PATTERN.replace("'", "''") + "')"


@register(f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def token_split(spark, d):
    tokens = text.split_tokens(F.col("text"))
    return view(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def vocabulary_merges() -> list[tuple[str, str]]:
    """The merges of a public vocabulary of this tokeniser's kind."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.load(f)["model"]["merges"]]


@register()
def bpe_tokenise(spark, d):
    return en.tokenise(view(spark, d, "documents"), vocabulary_merges(), key="doc_id", text="text")


@register()
def encode_batch(spark, d):
    def make():
        weight = np.random.default_rng(1).normal(size=(64, 16)).astype(np.float32)
        return en.padded(lambda x: x @ weight, 8)

    return en.encode_batches(view(spark, d, "embeddings"), make, column="embedding", shape=[64]).select("vec_id", "vector")


_HASHED = """SELECT doc_id, bucket, sum(sign) AS x FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 4))::INT % 64 AS bucket, 1.0 - 2.0 * (('0x' || substr(md5(t), 5, 1))::INT % 2) AS sign
 FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: t <> '')) AS t FROM documents)) GROUP BY ALL HAVING sum(sign) <> 0"""


@register(f"SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) + 0.0 AS x FROM ({_HASHED})")
def text_encode_hash(spark, d):
    found = en.hash_encode(view(spark, d, "documents"), key="doc_id", text="text")
    return rounded(found.select("doc_id", F.posexplode("vector").alias("bucket", "x")).where("x <> 0"), "x")


@register("SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(vector[pos + 1] AS DOUBLE) / sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) + 0.0 AS x FROM items, unnest(range(len(vector))) r(pos)", "items")
def l2_normalise(spark, d):
    return rounded(view(spark, d, "items").select("vec_id", F.posexplode(vectors.l2_normalise(F.col("vector"))).alias("pos", "x")), "x")


@register(
    """SELECT count(*) AS compared, round(min(c), 9) AS min_cosine, round(max(m), 9) AS max_diff, min(c) > 0.99999 AND max(m) < 1e-4 AS passed FROM (
 SELECT list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS c,
  list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] / sqrt(list_inner_product(a, a)) - b[i] / sqrt(list_inner_product(b, b))))) AS m
 FROM (SELECT CAST(vector AS DOUBLE[]) AS a, list_transform(CAST(vector AS DOUBLE[]), lambda x: 2.0 * x + 1e-5) AS b FROM items))""",
    "items",
)
def embedding_parity(spark, d):
    items = view(spark, d, "items")
    other = items.withColumn("vector", F.transform("vector", lambda x: 2.0 * x.cast("double") + 1e-5))
    return rounded(ev.parity(items, other, key="vec_id", vector="vector"), "min_cosine", "max_diff", digits=9)


# --- terms --------------------------------------------------------------------------------------

_MULT = r"regexp_extract(q, '^(\d+(?:\.\d+)?|\.\d+|\d+\.):(.+)$', 1)"
_BODY = rf"CASE WHEN {_MULT} = '' THEN q ELSE regexp_extract(q, '^(\d+(?:\.\d+)?|\.\d+|\d+\.):(.+)$', 2) END"


@register(f"SELECT doc_id, CASE WHEN {_MULT} = '' THEN 1.0 ELSE CAST({_MULT} AS DOUBLE) END AS multiplier, {_BODY} AS body FROM term_strings", "term_strings")
def parse_multiplier(spark, d):
    return view(spark, d, "term_strings").select("doc_id", terms.multiplier(F.col("q")).alias("multiplier"), terms.body(F.col("q")).alias("body"))


@register(
    rf"""SELECT doc_id, CASE WHEN starts_with(b, 'http://') OR starts_with(b, 'https://') THEN 'url'
 WHEN starts_with(b, '/') OR starts_with(b, 'file://') OR starts_with(b, './') OR regexp_matches(lower(b), '^[a-z]:\\') THEN 'file' ELSE 'phrase' END AS kind FROM (SELECT doc_id, {_BODY} AS b FROM term_strings)""",
    "term_strings",
)
def classify_query(spark, d):
    return view(spark, d, "term_strings").select("doc_id", terms.kind(terms.body(F.col("q"))).alias("kind"))


@register("SELECT doc_id, regexp_replace(q, '^file://', '') AS path FROM term_strings", "term_strings")
def strip_file_scheme(spark, d):
    return view(spark, d, "term_strings").select("doc_id", P.strip_file_scheme(F.col("q")).alias("path"))


@register("SELECT vec_id, string_split(string_split(filepath, '/')[-1], '_')[1] AS class FROM items", "items")
def class_from_path(spark, d):
    return view(spark, d, "items").select("vec_id", P.class_label(F.col("filepath")).alias("class"))


@register("SELECT doc_id, 'photo of ' || lang || ' ' || source AS prompt FROM documents")
def prompt_template(spark, d):
    return view(spark, d, "documents").select("doc_id", terms.prompt(F.concat_ws(" ", "lang", "source")).alias("prompt"))


# --- search -------------------------------------------------------------------------------------

_WEIGHTED = "SELECT qid, CAST(pos AS INTEGER) AS pos, sum(sign * multiplier * CAST(tvec[pos + 1] AS DOUBLE)) AS x FROM terms, unnest(range(len(tvec))) r(pos) GROUP BY qid, pos"


@register(f"SELECT qid, pos, round(x, 6) + 0.0 AS x FROM ({_WEIGHTED})", "terms")
def weighted_query_vector(spark, d):
    found = sr.weighted_vectors(view(spark, d, "terms"))
    return rounded(found.select("qid", F.posexplode("qvec").alias("pos", "x")), "x")


@register(f"SELECT vec_id, {_SCORE} AS score FROM items", "items")
def score_all(spark, d):
    items = view(spark, d, "items")
    return rounded(sr.score(items, first_vector(items)[1]).select("vec_id", "score"), "score")


_TOP = f"SELECT filepath, {_DOT.format('vector', _ZERO)} AS score FROM items WHERE {{}} ORDER BY score DESC, filepath LIMIT 10"


@register(f"SELECT filepath, round(score, 6) + 0.0 AS score FROM ({_TOP.format(_NOT_EXCLUDED)})", "items")
def search_topk(spark, d):
    items = view(spark, d, "items")
    return rounded(sr.search(items, first_vector(items)[1]), "score")


@register(f"SELECT filepath, round(score, 6) + 0.0 AS score FROM ({_TOP.format(_NOT_EXCLUDED.replace('({', '({') + ' AND vec_id <> (SELECT min(vec_id) FROM items)')})", "items")
def search_exclusions(spark, d):
    items = view(spark, d, "items")
    path, vector = first_vector(items)
    return rounded(sr.search(items, vector, query_files=[path]), "score")


@register(f"SELECT printf('%.3f', score) || chr(9) || '\"' || filepath || '\"' AS value FROM ({_TOP.format(_NOT_EXCLUDED)})", "items")
def result_format(spark, d):
    items = view(spark, d, "items")
    return sr.format_results(sr.search(items, first_vector(items)[1]))


@register(f"SELECT 'score' || chr(9) || 'filepath' AS value UNION ALL SELECT printf('%.3f', score) || chr(9) || '\"' || filepath || '\"' FROM ({_TOP.format(_NOT_EXCLUDED)})", "items")
def result_file(spark, d):
    """The file that the result sink writes, line by line."""
    items, path = view(spark, d, "items"), f"{shared_dir(spark)}/results-{uuid.uuid4().hex}.tsv"
    write_results(sr.search(items, first_vector(items)[1]), path)
    return spark.read.text(path)


@register(f"SELECT filepath FROM ({_TOP.format(_NOT_EXCLUDED)})", "items")
def result_paths_only(spark, d):
    items = view(spark, d, "items")
    return sr.search(items, first_vector(items)[1]).select("filepath")


@register(f"SELECT filepath, round(score, 6) + 0.0 AS score FROM ({_TOP.format(_NOT_EXCLUDED + " AND starts_with(filepath, '/photos/c1/')")})", "items")
def search_scoped(spark, d):
    items = view(spark, d, "items").withColumn("deleted", F.lit(None).cast("boolean"))
    return rounded(sr.search(ix.scan(items, "/photos/c1"), first_vector(items)[1]), "score")


def _pairs(query: str, k: int, where: str = "true") -> str:
    """SQL of the best k items of each query."""
    return f"""SELECT qid, vec_id, round(score, 6) + 0.0 AS score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rk
 FROM (SELECT q.qid, i.vec_id, {_DOT.format('i.vector', 'q.qvec')} AS score FROM ({query}) q, items i WHERE {where})) WHERE rk <= {k}"""


@register(_pairs("SELECT qid, qvec FROM queries", 100), "items queries")
def knn_join(spark, d):
    return rounded(sr.knn(view(spark, d, "items"), view(spark, d, "queries"), 100), "score")


@register(_pairs("SELECT qid, qvec FROM queries", 10, "q.qid <> i.vec_id"), "items queries")
def search_by_example(spark, d):
    """Ten items nearest to each example, itself left out."""
    found = sr.knn(view(spark, d, "items"), view(spark, d, "queries"), 11)
    # at most one row of a query is the example: what ranks after it moves up by one
    own = found.where("qid = vec_id").select("qid", F.col("rk").alias("own"))
    found = found.where("qid <> vec_id").join(own, "qid", "left").withColumn("rk", F.col("rk") - F.when(F.col("own") < F.col("rk"), 1).otherwise(0)).where("rk <= 10")
    return rounded(found.select("qid", "vec_id", "score", "rk"), "score")


@register(_pairs(f"SELECT qid, list(x ORDER BY pos) AS qvec FROM ({_WEIGHTED}) WHERE qid % 20 = 0 GROUP BY qid", 10), "items terms")
def search_weighted(spark, d):
    queries = sr.weighted_vectors(view(spark, d, "terms").where("qid % 20 = 0"))
    return rounded(sr.knn(view(spark, d, "items"), queries, 10), "score")


PHRASE = "the thing and that"


@register(
    f"""WITH docs AS (SELECT doc_id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM ({_HASHED})),
 query AS (SELECT bucket, x / sqrt(sum(x * x) OVER ()) AS x FROM ({_HASHED.replace('FROM documents', f"FROM (SELECT 0 AS doc_id, '{PHRASE}' AS text)")}))
 SELECT CAST(doc_id AS VARCHAR) AS filepath, round(coalesce(sum(d.x * q.x), 0), 6) + 0.0 AS score FROM docs d LEFT JOIN query q USING (bucket) GROUP BY doc_id ORDER BY round(coalesce(sum(d.x * q.x), 0), 6) DESC, CAST(doc_id AS VARCHAR) LIMIT 10"""
)
def search_text(spark, d):
    query = en.hash_encode(spark.createDataFrame([(0, PHRASE)], "qid int, text string"), key="qid", text="text").first()[1]
    items = en.hash_encode(view(spark, d, "documents"), key="doc_id", text="text").withColumn("filepath", F.col("doc_id").cast("string"))
    # equal texts differ in the last bits by the order of sums: scores are rounded before ties are broken
    return sr.top_k(rounded(sr.score(items, query), "score"), 10).select("filepath", "score")


# --- evaluation ---------------------------------------------------------------------------------

_RANKED = f"""SELECT vec_id, label, class_id, score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id) AS INTEGER) AS rk
 FROM (SELECT vec_id, label, class_id, {_DOT.format('vector', 'cvec')} AS score FROM items, classes)"""


@register(f"SELECT vec_id, class_id, round(score, 6) + 0.0 AS score, rk FROM ({_RANKED}) WHERE rk <= 5", "items classes")
def zero_shot_predict(spark, d):
    return rounded(ev.rank_classes(view(spark, d, "items"), view(spark, d, "classes")), "score")


@register(
    f"SELECT count(*) AS processed, avg(a) AS top1, avg(b) AS top5 FROM (SELECT vec_id, max(CASE WHEN rk = 1 AND class_id = label THEN 1 ELSE 0 END) AS a, max(CASE WHEN rk <= 5 AND class_id = label THEN 1 ELSE 0 END) AS b FROM ({_RANKED}) GROUP BY vec_id)",
    "items classes",
)
def zero_shot_accuracy(spark, d):
    return ev.accuracy(ev.rank_classes(view(spark, d, "items"), view(spark, d, "classes"), keep=("label",)))


@register(
    f"SELECT count(*) AS queries, round(avg(p), 9) AS precision FROM (SELECT f.qid, avg(CASE WHEN i.label = q.qlabel THEN 1.0 ELSE 0.0 END) AS p FROM ({_pairs('SELECT qid, qvec FROM queries', 100)}) f JOIN items i USING (vec_id) JOIN queries q ON q.qid = f.qid GROUP BY f.qid)",
    "items queries",
)
def precision_at_k(spark, d):
    return rounded(ev.precision(view(spark, d, "items"), view(spark, d, "queries")), "precision", digits=9)


@register("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id), vec_id) AS n FROM items) WHERE n <= 10", "items")
def sample_per_class(spark, d):
    return ev.sample_per_class(view(spark, d, "items"), 10, label="label", key="vec_id").select("vec_id", "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
