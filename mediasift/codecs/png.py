"""PNG files of every colour kind and depth, plain or interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Rows that are unfiltered together.
BAND = 512
# First column and row and steps of the passes of an interlaced image.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def wavefront(how: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes the filters of a band of rows (h x w x n), whose pixels need those left, above and left above.

    Pixels with the same sum of row and column need none of each other, so a diagonal is one step. The band is
    written aslant: pixel (y, x) at [x + y + 1, y + 1], which makes diagonals and their neighbours plain slices."""
    h, w, n = rows.shape
    slant = np.zeros((w + h + 1, h + 1, n), np.int16)
    slant[1 : w + 1, 0] = above  # the row above is row -1, on diagonals one earlier
    for y in range(h):
        slant[y + 2 : y + 2 + w, y + 1] = rows[y]
    kind = how.astype(np.int16)[:, None]
    paeth, mean = bool((how == 4).any()), bool((how == 3).any())
    for d in range(w + h - 1):
        lo, hi = max(0, d - w + 1), min(h, d + 1)
        left, up, corner = slant[d + 1, lo + 1 : hi + 1], slant[d + 1, lo:hi], slant[d, lo:hi]
        if hi == d + 1:  # the first pixel of a row has nothing to its left
            left, corner = left.copy(), corner.copy()
            left[-1] = corner[-1] = 0
        k = kind[lo:hi]
        near = np.where(k == 1, left, np.where(k == 2, up, 0))
        if mean:
            near = np.where(k == 3, (left + up) >> 1, near)
        if paeth:
            a, b = up - corner, left - corner
            c = np.abs(a + b)
            a, b = np.abs(a), np.abs(b)
            near = np.where(k == 4, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)), near)
        slant[d + 2, lo + 1 : hi + 1] = (slant[d + 2, lo + 1 : hi + 1] + near) & 255
    return np.stack([slant[y + 2 : y + 2 + w, y + 1] for y in range(h)]).astype(np.uint8)


def unfiltered(data: np.ndarray, n: int) -> np.ndarray:
    """Rows of filter and bytes to bytes; n bytes are a pixel."""
    how, rows = data[:, 0], data[:, 1:].reshape(len(data), -1, n)
    if how.max(initial=0) > 4:
        raise ValueError("cannot identify image file: filter")
    out, above = np.empty_like(rows), np.zeros(rows.shape[1:], np.uint8)
    for lo in range(0, len(rows), BAND):
        kinds, part = how[lo : lo + BAND], rows[lo : lo + BAND]
        if (kinds > 2).any():
            out[lo : lo + BAND] = wavefront(kinds, part, above)
        else:
            for y in range(len(part)):
                line = np.cumsum(part[y], axis=0, dtype=np.uint8) if kinds[y] == 1 else part[y] + above if kinds[y] == 2 else part[y]
                out[lo + y] = above = line
        above = out[min(lo + BAND, len(rows)) - 1]
    return out.reshape(len(rows), -1)


def decode_png(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes; of 16 bits a channel the higher 8."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("cannot identify image file")
    at, data, palette = 8, [], None
    try:
        w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", raw[16:29])
        while at < len(raw):
            size, name = struct.unpack(">I4s", raw[at : at + 8])
            body, at = raw[at + 8 : at + 8 + size], at + 12 + size
            if name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"IDAT":
                data.append(body)
            elif name == b"IEND":
                break
        bits = CHANNELS[kind] * depth
        if depth not in (1, 2, 4, 8, 16) or (depth < 8 and kind not in (0, 3)) or (depth == 16 and kind == 3) or not w or not h:
            raise ValueError("cannot identify image file: bits a channel")
        flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
        out = np.zeros((h, w, CHANNELS[kind]), np.uint8)
        for x, y, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
            pw, ph = -(-(w - x) // dx), -(-(h - y) // dy)
            if pw > 0 and ph > 0:
                line = 1 + (pw * bits + 7) // 8
                part, flat = unfiltered(flat[: line * ph].reshape(ph, line), max(1, bits // 8)), flat[line * ph :]
                if depth < 8:
                    part = np.unpackbits(part, axis=1).reshape(ph, -1, depth)[:, :pw]
                    part = np.packbits(part, axis=2)[:, :, 0] >> (8 - depth)
                elif depth == 16:
                    part = part[:, ::2]
                out[y::dy, x::dx] = part.reshape(ph, pw, -1)
    except (struct.error, zlib.error, KeyError, ValueError) as error:
        raise ValueError(f"cannot identify image file: {error}") from error
    if kind == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("cannot identify image file: palette")
        return palette[out[:, :, 0]]
    if depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(out[:, :, :1], 3, axis=2) if out.shape[2] < 3 else np.ascontiguousarray(out[:, :, :3])
