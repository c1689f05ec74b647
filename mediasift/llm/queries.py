"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.quality import repetition_rules

    return repetition_rules(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm import language_id as li

    docs = table(spark, sf_dir, "documents")
    fold = li.hash_mod(F.col("doc_id"), 3)
    model = li.fit(docs.where(F.coalesce(fold != 1, F.lit(True))))
    return li.identify(docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), model, keep=["doc_id", "held_out"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm import token_store as ts
    from mediasift.llm.shared import shared_dir

    root = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ts.write_tokens(table(spark, sf_dir, "documents"), root, tokenizer_file())
    return ts.read_tokens(spark, root)


def op7_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm import language_model as lm
    from mediasift.llm.language_id import hash_mod

    docs = table(spark, sf_dir, "documents")
    fold = hash_mod(F.col("doc_id"), 5)
    model = lm.train(docs.where(F.coalesce(fold != 1, F.lit(True))))
    scores = lm.score_texts(docs, model, F.coalesce(fold == 1, F.lit(False)))
    model.close()
    return scores


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.warc_query import resolved_revisits

    return resolved_revisits(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.hyperplane_tree import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.exact_topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasift.llm.prefix_trie import grafted, prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), grafted, 8).drop("enter_at", "leave_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_rules": op1_quality_rules, "op2_jaccard_join": op2_jaccard_join, "op3_html_text": op3_html_text, "op4_language_id": op4_language_id, "op5_suffix_dedup": op5_suffix_dedup, "op6_token_store": op6_token_store, "op7_ngram_scores": op7_ngram_scores, "op8_warc_revisits": op8_warc_revisits, "op9_decontamination": op9_decontamination, "op10_poisson_mixture": op10_poisson_mixture, "op11_hard_negatives": op11_hard_negatives, "op12_exact_topk": op12_exact_topk, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    from mediasift.llm import quality_sql, warc_query

    return {"op1_quality_rules": quality_sql.sql(), "op8_warc_revisits": warc_query.SQL, "op10_poisson_mixture": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_exact_topk": OP12_SQL, "op13_prefix_trie": OP13_SQL}


OP10_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY source
), raws AS (
  SELECT source, chars, sum(chars) OVER () AS all_chars,
         CASE WHEN chars > 0 THEN pow(chars / (sum(chars) OVER ()), 0.5) ELSE 0.0 END AS raw FROM sizes
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN coalesce(raw / nullif(sum(raw) OVER (), 0), 0.0) * all_chars / chars ELSE 0.0 END AS rate FROM raws
), parts AS (
  SELECT source, rate, CAST(greatest(1, ceil(rate / 64.0)) AS INTEGER) AS p FROM rates
), cdf(source, mean, k, term, total) AS (
  SELECT source, rate / p, 0, exp(-(rate / p)), exp(-(rate / p)) FROM parts
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM cdf
  WHERE k < ceil(mean + 12.0 * sqrt(mean) + 24.0)
), drawn AS (
  SELECT d.*, r.rate, i.i, ('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(md5(d.text), '') || ':' || CAST(i.i AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, r.p + 1)) AS i) i
), counted AS (
  SELECT w.doc_id, w.text, w.lang, w.source, w.n_chars, w.rate, w.i,
         CAST((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM w.source AND c.total <= w.u) AS INTEGER) AS n FROM drawn w
), summed AS (
  SELECT doc_id, text, lang, source, n_chars, rate, CAST(sum(n) AS INTEGER) AS n FROM counted GROUP BY ALL
), replicas AS (
  SELECT doc_id, text, lang, source, n_chars, rate, CAST(unnest(range(1, n + 1)) AS INTEGER) AS replica FROM summed
)
SELECT *, md5('order17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':' || CAST(replica AS VARCHAR)) AS shuffle_key FROM replicas
"""

OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""

OP12_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
FROM rows q, rows c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 20
"""

OP13_SQL = """
WITH digests AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash, strlen(coalesce(text, '')) AS n_bytes
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({t: turn_hash, b: n_bytes} ORDER BY turn NULLS FIRST, turn_hash) AS turns FROM digests GROUP BY conv_id
), drawn AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM own
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(b.turns[1:d.h], []), d.turns[d.h + 1:]) AS turns FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 5
), prefixes AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), keyed AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, array_to_string(list_transform(turns[1:depth], lambda x: x.t), '') AS key, CASE WHEN depth > 0 THEN turns[depth].b ELSE 0 END AS n_bytes FROM prefixes
), nodes AS (
  SELECT depth, key, min(conv_id) AS rep, count(*) AS n_convs, max(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM keyed GROUP BY depth, key
), members AS (
  SELECT k.conv_id, k.depth, n.rep FROM keyed k JOIN nodes n USING (depth, key)
), parents AS (
  SELECT n.*, m.rep AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.rep AND m.depth = n.depth - 1
), children AS (
  SELECT parent AS rep, depth - 1 AS depth, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL
), subtrees AS (
  SELECT m.rep, m.depth, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved
  FROM nodes n JOIN members m ON m.conv_id = n.rep AND m.depth <= n.depth LEFT JOIN children c ON c.rep = n.rep AND c.depth = n.depth GROUP BY ALL
)
SELECT p.rep AS conv_id, p.depth, p.parent AS parent_conv_id, p.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, p.ends_sha256
FROM parents p LEFT JOIN children c USING (rep, depth) JOIN subtrees s USING (rep, depth)
"""
