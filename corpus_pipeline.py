"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read again.

Language ID drops documents without a recognised language, the Jaccard join keeps one document of
each group of near duplicates, decontamination drops documents that hold a benchmark item, mixing
repeats sources to their target weights, and the token store encodes what is left. All stages but
the last return the columns of ``documents``. No SQL is given: the first stages are learned or
approximate searches that SQL cannot express; tests hold them against brute force.

Every stage takes any rows with the columns of ``documents``, whatever else they have. A null or empty
text, or one without letters, goes in the first stage. Ids may be null or repeated: documents are told apart by
id and text, and rows that agree in both are copies. Texts of any length are read whole. Of documents
with equal claims the smallest id stays, then the smallest hash of the text. An empty table passes
through as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm import decontaminate, jaccard, language_id, mixing, token_store
from mediasift.llm.queries import tokenizer_file
from mediasift.llm.shared import Tables, finished, shared_dir, table

#: A document is rejected when its text has no letters, or no language reaches this probability.
MIN_LANGUAGE_SCORE = 0.5
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; the model learns from two of three folds."""
    model = language_id.fit(docs.where(F.coalesce(language_id.hash_mod(F.col("doc_id"), 3) != 1, F.lit(True))))
    found = language_id.identify(docs, model, lang_col="__lang", score_col="__score")
    return found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class (of those, the smallest hash of the text).

    Ids need not be unique or given: documents are told apart by id and text. Repeated rows (an id and
    text seen before) are copies: one stays. Texts without words are in no class; those without an
    id stay."""
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = docs.where(~words & F.col("doc_id").isNull())
    # never null, so that the aggregation and the join are dealt alike and texts are shuffled once
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("th").cast("string")).alias("__row")
    one = docs.where(words | F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("__all"), F.col("doc_id"), F.xxhash64("text").alias("th"))
    # of equal claims one row, whatever the order of tasks
    one = one.select(row, "__all").groupBy("__row").agg(F.min_by("__all", F.xxhash64("__all")).alias("__all"))
    alone = docs.where(~words & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("th")).distinct()
    lead = jaccard.leaders(docs).unionByName(alone).select(row)
    return one.join(lead, "__row", "left_semi").select("__all.*").unionByName(rest)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole, edited or paraphrased."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources approach the square roots of their shares; draws are of id and text."""
    return mixing.mix_sources(docs, columns="input")


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and writes all documents, and reads back a row for each."""
    root = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(docs, root, tokenizer_file())
    return token_store.read_tokens(spark, root)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing to target weights", mix_to_weights),
    ("token-ID output", store_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with finished():  # a stage's own tables go once its result is written; token files stay
            docs = tables.save(stage(spark, docs, sf_dir), f"stage{k}")
        decontaminate.release()
        if k:
            tables.drop(f"stage{k - 1}")
    return docs
