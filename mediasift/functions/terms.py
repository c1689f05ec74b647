"""Query terms: multipliers and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: an optional decimal multiplier and a colon before the query.
MULTIPLIER = "^(\\d+(?:\\.\\d+)?|\\.\\d+|\\d+\\.):(.+)$"


def multiplier(q: Column) -> Column:
    found = F.regexp_extract(q, MULTIPLIER, 1)
    return F.when(found == "", F.lit(1.0)).otherwise(found.try_cast("double"))


def body(q: Column) -> Column:
    found = F.regexp_extract(q, MULTIPLIER, 2)
    return F.when(found == "", q).otherwise(found)


def kind(term: Column) -> Column:
    """``url``, ``file`` or ``phrase`` of a query body."""
    low = F.lower(term)
    is_file = term.startswith("/") | term.startswith("file://") | term.startswith("./") | low.rlike("^[a-z]:\\\\")
    return F.when(term.startswith("http://") | term.startswith("https://"), "url").when(is_file, "file").otherwise("phrase")


def parse(q: Column) -> Column:
    return F.struct(multiplier(q).alias("multiplier"), body(q).alias("body"), kind(body(q)).alias("kind"))


def prompt(description: Column) -> Column:
    return F.concat(F.lit("photo of "), description)
