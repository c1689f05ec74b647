"""Path expressions: extensions, scope, hidden and excluded directories, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions the library takes as images, and directories it skips by default.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "heic", "tiff", "tif", "bmp", "gif", "jp2", "pnm", "pbm", "pgm", "ppm"]
RAW_EXTENSIONS = ["arw", "cr2", "dng"]
EXCLUDED_DIRS = ["@eaDir", "node_modules", ".git", "System Volume Information"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; names with leading dots only have none."""
    return F.lower(F.regexp_extract(path, "(?:^|/)\\.*[^/.][^/]*\\.([^/.]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]*$", "")


def extension_regex(extensions: list[str]) -> str:
    return "(?i)^.+\\.(" + "|".join(map(re.escape, extensions)) + ")$"


def exclude_regex(dirs: list[str] | None) -> str:
    """Matches a directory inside, or equal to, one of the named ones; no names: the default ones."""
    return "^.+/(" + "|".join(map(re.escape, dirs or EXCLUDED_DIRS)) + ")(/.+)?$"


def is_hidden(relative: Column) -> Column:
    """True when any component of a path below the root starts with a dot."""
    return F.exists(F.split(relative, "/"), lambda c: c.startswith("."))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lower(text: str) -> str:
    """As ``ascii_lower``."""
    return "".join(c.lower() if c in UPPER else c for c in text)


def scope_prefix(directory: str) -> str:
    """What paths below a directory begin with: it ends in one separator."""
    sep = "\\" if "\\" in directory and "/" not in directory else "/"
    return directory if directory.endswith(sep) else directory + sep


def in_scope(path: Column, prefix: str, case_sensitive: bool = False) -> Column:
    """True below a directory. The prefix has no wildcards."""
    prefix = scope_prefix(prefix)
    return path.startswith(prefix) if case_sensitive else ascii_lower(path).startswith(lower(prefix))


def class_label(path: Column) -> Column:
    return F.substring_index(file_name(path), "_", 1)


def strip_file_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file://", "")
