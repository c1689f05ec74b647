"""Text expressions: cleaning, splitting, and the hashing encoder used where no model is given."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that are kept whole, and the pattern of the others: contractions, letter runs, single digits, other runs.
SPECIAL_TOKENS = ["<start_of_text>", "<end_of_text>"]
TOKEN_PATTERN = "<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"
WIDTH = 64


@F.pandas_udf(T.StringType())
def unescape_twice(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(html.unescape(t)))


def clean(text: Column, unescape: bool = True) -> Column:
    """References decoded, white space collapsed and trimmed, lower case."""
    text = unescape_twice(text) if unescape else text
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def split_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
