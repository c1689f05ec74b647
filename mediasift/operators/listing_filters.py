"""Filters over a table of paths (columns filepath and whatever else)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.functions import paths as P


def with_extension(listing: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    return listing.where(P.file_name(F.col("filepath")).rlike(P.extension_regex(extensions or P.IMAGE_EXTENSIONS)))


def not_excluded(listing: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    return listing.where(~P.directory(F.col("filepath")).rlike(P.exclude_regex(dirs)))


def not_hidden(listing: DataFrame, root: str) -> DataFrame:
    return listing.where(~P.is_hidden(F.expr(f"substring(filepath, {len(root.rstrip('/')) + 2})")))


def without_shadowed_raw(listing: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Drops raw files beside a processed file with the same stem and an extension all in lower or
    all in upper case. ``processed`` (default: the listing) is where such siblings are looked for."""
    sibling = (processed if processed is not None else listing).select("filepath")
    name = P.file_name(F.col("filepath"))
    known = P.IMAGE_EXTENSIONS + [e.upper() for e in P.IMAGE_EXTENSIONS]
    sibling = sibling.where(F.substring_index(name, ".", -1).isin(*known)).select(P.stem(F.col("filepath")).alias("__stem")).distinct()
    raw = P.extension(F.col("filepath")).isin(*P.RAW_EXTENSIONS)
    # files that are not raw have a null key and stay
    return listing.join(sibling, F.when(raw, P.stem(F.col("filepath"))) == F.col("__stem"), "left_anti")


def library_view(listing: DataFrame, root: str, *, exclude_dirs: list[str] | None = None, include_hidden: bool = False, raw_support: bool = False) -> DataFrame:
    """What the library shows: all filters together."""
    out = with_extension(listing, P.IMAGE_EXTENSIONS + (P.RAW_EXTENSIONS if raw_support else []))
    out = not_excluded(out, exclude_dirs)
    out = out if include_hidden else not_hidden(out, root)
    return without_shadowed_raw(out, listing) if raw_support else out
