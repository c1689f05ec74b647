"""Inputs of the registered queries, derived from the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# some files lie in directories that searches leave out
_FILEPATH = "concat('/photos/c', label, CASE vec_id % 17 WHEN 3 THEN '/node_modules' WHEN 4 THEN '/@eaDir/x' ELSE '' END, '/n', label, '_', vec_id, '.jpg')"
_TERM = r"""CASE doc_id % 16 WHEN 0 THEN concat('1.5:', s) WHEN 1 THEN s WHEN 2 THEN concat('1:', s) WHEN 3 THEN concat('0.5:', s)
 WHEN 4 THEN concat('.5:', s) WHEN 5 THEN concat('1.:', s) WHEN 6 THEN concat('1..:', s) WHEN 7 THEN concat('..:', s)
 WHEN 8 THEN concat('whatever:', s) WHEN 9 THEN concat('10:30 ', s) WHEN 10 THEN concat('2:./', s, '.jpg') WHEN 11 THEN concat('file:///a/', s, '.jpg')
 WHEN 12 THEN concat('https://e.com/', s) WHEN 13 THEN concat('/abs/', s, '.png') WHEN 14 THEN concat('C:\', s, '.jpg') ELSE concat('../', s) END"""
_PATH = """concat('/lib/', CASE (doc_id - doc_id % 2) % 18 WHEN 0 THEN '.hid' WHEN 2 THEN 'node_modules' WHEN 4 THEN '@eaDir/x' WHEN 6 THEN '_ok'
 ELSE concat('d', (doc_id - doc_id % 2) % 5) END, '/', CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END, 'f', doc_id - doc_id % 2, '.',
 CASE doc_id % 8 WHEN 0 THEN 'jpg' WHEN 1 THEN 'arw' WHEN 2 THEN 'PNG' WHEN 3 THEN 'CR2' WHEN 4 THEN 'Tiff' WHEN 5 THEN 'dng' WHEN 6 THEN 'txt' ELSE 'DNG' END)"""
_MESSAGE = """CASE image_id % 6 WHEN 0 THEN concat('Image size (', width * height, ' pixels) exceeds limit') WHEN 1 THEN 'cannot identify image file'
 WHEN 2 THEN 'out of memory while decoding' WHEN 3 THEN 'broken pipe' ELSE NULL END"""

#: name -> (tables or views it reads, SQL that both engines run; {sha} is the engine's SHA-256).
VIEWS = {
    "items": f"SELECT vec_id, {_FILEPATH} AS filepath, label, embedding AS vector FROM embeddings",
    "queries": "SELECT vec_id AS qid, embedding AS qvec, label AS qlabel FROM embeddings WHERE vec_id % 20 = 0",
    "terms": "SELECT CAST(floor(vec_id / 3) AS BIGINT) AS qid, vec_id AS term_id, CASE WHEN vec_id % 3 = 2 THEN -1 ELSE 1 END AS sign, CAST(0.5 * (1 + vec_id % 4) AS DOUBLE) AS multiplier, embedding AS tvec FROM embeddings",
    "classes": "SELECT label AS class_id, embedding AS cvec FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)",
    "term_strings": f"SELECT doc_id, {_TERM} AS q FROM (SELECT doc_id, concat(lang, '_', source) AS s FROM documents) t",
    "paths": f"SELECT doc_id, {_PATH} AS filepath FROM documents",
    "docs_files": "SELECT doc_id, concat('/lib/', lang, '/', source, '/', doc_id, '.jpg') AS filepath, CAST(doc_id AS DOUBLE) + CAST(0.5 AS DOUBLE) AS modified_at, CAST(n_chars AS BIGINT) AS size, {sha} AS hash FROM documents",
    "listing": "SELECT filepath, modified_at, size, hash FROM docs_files WHERE doc_id % 13 <> 0",
    "idx": """SELECT f.filepath, f.modified_at - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS modified_at, f.size,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE f.hash END AS hash, e.embedding AS vector, CASE WHEN doc_id % 17 = 0 THEN true END AS deleted
 FROM docs_files f JOIN embeddings e ON e.vec_id = f.doc_id % 500 WHERE doc_id % 10 <> 0
 UNION ALL SELECT concat('/other/', doc_id, '.jpg'), f.modified_at, f.size, f.hash, e.embedding, NULL
 FROM docs_files f JOIN embeddings e ON e.vec_id = f.doc_id % 500 WHERE doc_id % 29 = 0""",
    "image_dims": "SELECT image_id, concat('/img/', image_id, '.jpg') AS filepath, width, height, " + _MESSAGE + " AS error FROM (SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(100 + (p_partkey * 7919) % 20000 AS BIGINT) AS width, CAST(100 + (p_partkey * 104729) % 12000 AS BIGINT) AS height FROM part) p",
}
NEEDS = {"listing": ["docs_files"], "idx": ["docs_files"]}
TABLES = {"items": ["embeddings"], "queries": ["embeddings"], "terms": ["embeddings"], "classes": ["embeddings"], "term_strings": ["documents"], "paths": ["documents"], "docs_files": ["documents"], "listing": [], "idx": ["embeddings"], "image_dims": ["part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input; nothing is registered in the session's catalog."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: view(spark, sf_dir, n) for n in [*TABLES[name], *NEEDS.get(name, [])]}
    sql = VIEWS[name].format(sha="sha2(text, 256)").replace("\\", "\\\\")
    for n in parts:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **parts)


def with_views(names: str, body: str) -> str:
    """DuckDB's SQL for a query over the named views."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(sha='sha256(text)')})" for n in order) + " " + body


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded for comparison; adding zero makes a negative zero positive."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
