"""File and image expressions: fingerprints, pixel caps, geometry, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, TAIL = 1 << 20, 1024
#: Fixed value: the least automatic pixel cap.
LEAST_CAP = 89_478_485
SIDE = 256
# Channel means and deviations of the image encoder.
MEAN = [0.48145466, 0.4578275, 0.40821073]
STD = [0.26862954, 0.26130258, 0.27577711]


def fingerprint(content: Column) -> Column:
    """SHA-256 of the first mebibyte and, for more than a kibibyte, the last kibibyte."""
    tail = F.when(F.octet_length(content) > TAIL, F.substring(content, -TAIL, TAIL)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.substring(content, 1, HEAD), tail), 256)


def default_cap(total_memory: int, workers: int) -> int:
    return max(LEAST_CAP, int(total_memory * 0.5 / (max(1, workers) * 4)))


def parse_cap(text: str, total_memory: int = 0, workers: int = 1) -> int | None:
    """Pixels of ``auto``, of a number of megapixels, or None where the cap is off."""
    low = text.strip().lower()
    if low == "auto":
        return default_cap(total_memory, workers)
    if low in ("none", "off", "disable", "disabled", "0"):
        return None
    value = float(low)
    if not value > 0 or value == float("inf"):
        raise ValueError(f"not a positive number of megapixels: {text}")
    return round(value * 1e6)


def within_cap(width: Column, height: Column, cap: int | None) -> Column:
    return F.lit(True) if cap is None else width * height <= F.lit(cap)


def bomb_pixels(message: Column) -> Column:
    found = F.regexp_extract(message, "Image size \\((\\d+) pixels\\)", 1)
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def megapixels(pixels: Column) -> Column:
    return F.format_string("%.0f", pixels / F.lit(1e6))


def resized(width: Column, height: Column, side: int = SIDE) -> tuple[Column, Column]:
    """Shortest side to ``side``, the other truncated."""
    w = F.when(width <= height, F.lit(side)).otherwise(F.floor(width * side / height)).cast("bigint")
    h = F.when(width <= height, F.floor(height * side / width)).otherwise(F.lit(side)).cast("bigint")
    return w, h


def crop_offset(size: Column, side: int = SIDE) -> Column:
    """Half the excess, rounded half to even."""
    return F.bround((size - side) / F.lit(2.0)).cast("bigint")
