"""Pixels of image files: JPEG, PNG, GIF (its first frame), BMP and portable anymaps, in numpy."""

from __future__ import annotations

import numpy as np

from mediasift.codecs.jpeg import decode_jpeg
from mediasift.codecs.plain import decode_anymap, decode_bmp, decode_gif
from mediasift.codecs.png import decode_png

__all__ = ["decode_anymap", "decode_bmp", "decode_gif", "decode_image", "decode_jpeg", "decode_png"]


def decode_image(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of an image; what the file's first bytes say counts, not its name.

    Other formats, and damaged files, are a ValueError. Transparency and orientation tags are left out."""
    if raw[:2] == b"\xff\xd8":
        return decode_jpeg(raw)
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(raw)
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return decode_gif(raw)
    if raw[:2] == b"BM":
        return decode_bmp(raw)
    if len(raw) > 2 and raw[:1] == b"P" and raw[1:2] in b"123456" and raw[2:3].isspace():
        return decode_anymap(raw)
    raise ValueError("cannot identify image file")
