"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every source gets a mean repetition rate so that its expected share of the characters of the
mixture is its target weight; each document's repetition count is the inverse of the Poisson
distribution with that mean at a number hashed from the seed, the document's key and its text, found in the source's
distribution function, which is worked out once for each source. The count
needs no state and no order, so a retried or speculative task gives the same rows. The replicas
are then dealt to partitions and ordered by another hash, which is a global shuffle.

Nulls: a null source is a source of its own, a null text has no characters, a null key or text is hashed
as the empty string; different texts without a key, or of one key, are drawn and dealt apart. Rows that agree in key and text are replicated alike. Sources without characters get a rate of
zero if they have a weight, since no repetition reaches it. A text of any length counts whole; equal hashes of
two documents draw equal counts. An empty table gives an empty table.
Columns other than the three named ones pass through; those with the names of the three columns that
``columns="all"`` adds (rate, replica, shuffle_key) are replaced by them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.shared import Tables

#: The largest mean for which exp(-mean) is well inside the doubles; beyond, the rate is split.
MOST_MEAN = 64.0
#: Up to so many sources, the rates and distributions (at most 1.6 kB each) are sent to all executors.
BROADCAST_SOURCES = 20_000


def uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1) from 52 bits of an md5 of the seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. mean + 12 * sqrt(mean) + 24 of X ~ Poisson(mean), by the recurrence of the terms.
    Less than 2**-52 is left beyond, and uniform numbers have 52 bits."""
    steps = F.sequence(F.lit(1), F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(24.0)).cast("int"))
    zero = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * mean / i.cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), F.concat(acc["all"], F.array(acc["total"] + term)).alias("all"))

    return F.aggregate(steps, zero, step, lambda acc: acc["all"])


def poisson_inverse(cdf: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | DataFrame | None, *, source: str = "source", text: str = "text", temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """A row per source: its characters, target weight and mean repetition rate.

    ``weights`` (a dict, or a table of source and weight) are relative and are normalised over the sources that
    have characters; sources that they do not name get none. ``None``
    takes each source's share of characters to the power ``temperature``. ``budget`` is the size of
    the mixture as a multiple of the input. All counts cover all documents.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("docs"))
    sizes = Tables(docs.sparkSession, "sources").save(sizes, "sizes")  # a row per source, for the two totals below
    all_chars = F.lit(sizes.agg(F.sum("chars")).first()[0] or 0)
    if weights is None:
        raw = F.when(F.col("chars") > 0, F.pow(F.col("chars") / all_chars, F.lit(temperature))).otherwise(0.0)
    else:
        if isinstance(weights, dict):
            listed = json.dumps([{"name": name, "given": float(weight)} for name, weight in weights.items()])
            weights = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<name string, given double>>")))
        given = weights.toDF("name", "given")
        sizes = sizes.join(given, sizes["source"].eqNullSafe(given["name"]), "left").drop("name")
        raw = F.when(F.col("chars") > 0, F.coalesce("given", F.lit(0.0))).otherwise(0.0)
    all_raw = F.lit(sizes.agg(F.sum(raw)).first()[0] or 0.0)
    weighted = sizes.withColumn("weight", F.when(all_raw > 0, raw / all_raw).otherwise(0.0))
    rate = F.when(F.col("chars") > 0, F.lit(float(budget)) * F.col("weight") * all_chars / F.col("chars")).otherwise(0.0)
    return weighted.select("source", "docs", "chars", "weight", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, temperature: float = 0.5, budget: float = 1.0, columns: str = "all") -> DataFrame:
    """Replicate and shuffle ``docs``; ``columns="all"`` adds rate, replica and shuffle_key."""
    # a row per source, written once: the distribution is worked out for each source, not for each document
    rates = source_rates(docs, weights, source=source, text=text, temperature=temperature, budget=budget)
    # a mean above MOST_MEAN is the sum of equal Poisson parts with hashes of their own
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MOST_MEAN)).cast("int"))
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), parts.alias("__parts"), poisson_cdf(F.col("rate") / parts).alias("__cdf"))
    rates = Tables(docs.sparkSession, "rates").save(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:  # else a join that splits hot sources
        rates = F.broadcast(rates)
    names = [c for c in docs.columns if columns == "input" or c not in ("rate", "replica", "shuffle_key")]
    joined = docs.join(rates, docs[source].eqNullSafe(rates["__source"]), "left").withColumn("__text", F.coalesce(F.md5(F.col(text)), F.lit("")))
    count = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda p: poisson_inverse(F.col("__cdf"), uniform(seed, F.col(key), F.col("__text"), p))),
        F.lit(0), lambda a, b: a + b,
    )
    out = joined.withColumn("__n", count).where("__n > 0").withColumn("__replica", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    out = out.withColumn("__order", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__text"), F.col("__replica").cast("string"))))
    out = out.repartition(F.col("__order")).sortWithinPartitions("__order")
    keep = [F.col(f"`{c}`") for c in names]
    return out.select(*keep) if columns == "input" else out.select(*keep, F.col("__rate").alias("rate"), F.col("__replica").alias("replica"), F.col("__order").alias("shuffle_key"))
