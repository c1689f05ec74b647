"""GIF (first frame), BMP and portable anymaps."""

from __future__ import annotations

import re
import struct

import numpy as np


def unpacked(rows: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Rows of bytes to numbers of 1, 2, 4 or 8 bits."""
    if bits == 8:
        return rows[:, :width]
    parts = np.packbits(np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits), axis=2)[:, :, 0] >> (8 - bits)
    return parts[:, :width]


def lzw(data: bytes, first_bits: int, most: int) -> bytes:
    """Expands the codes of a GIF up to ``most`` bytes."""
    clear, end = 1 << first_bits, (1 << first_bits) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, out, size = list(roots), first_bits + 1, None, [], 0
    held, n = 0, 0
    for byte in data:
        held |= byte << n
        n += 8
        while n >= width:
            code, held, n = held & ((1 << width) - 1), held >> width, n - width
            if code == clear:
                table, width, last = list(roots), first_bits + 1, None
                continue
            if code == end or size >= most:
                return b"".join(out)[:most]
            if last is None:
                word = table[code] if code < clear else None
            elif code < len(table):
                word = table[code]
            else:
                word = last + last[:1] if code == len(table) else None
            if word is None:
                raise ValueError("cannot identify image file: codes")
            out.append(word)
            size += len(word)
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = word
    return b"".join(out)[:most]


def decode_gif(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of the first frame, on the file's background."""
    try:
        w, h, flags, background = struct.unpack("<HHBB", raw[6:12])
        at, shared = 13, None
        if flags & 128:
            size = 2 << (flags & 7)
            shared = np.frombuffer(raw[at : at + 3 * size], np.uint8).reshape(-1, 3)
            at += 3 * size
        while raw[at] != 0x2C:
            if raw[at] != 0x21:
                raise ValueError("no frame")
            at += 2
            while raw[at]:
                at += 1 + raw[at]
            at += 1
        left, top, fw, fh, local = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
        at, colours = at + 10, shared
        if local & 128:
            size = 2 << (local & 7)
            colours = np.frombuffer(raw[at : at + 3 * size], np.uint8).reshape(-1, 3)
            at += 3 * size
        first_bits, at, parts = raw[at], at + 1, []
        while raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        flat = np.frombuffer(lzw(b"".join(parts), first_bits, fw * fh), np.uint8)
        if len(flat) < fw * fh or colours is None or flat.max(initial=0) >= len(colours):
            raise ValueError("image file is truncated")
    except (struct.error, IndexError, ValueError) as error:
        raise ValueError(f"cannot identify image file: {error}") from error
    frame = colours[flat.reshape(fh, fw)]
    if local & 64:
        rows = np.concatenate([np.arange(a, fh, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        frame = frame[np.argsort(rows)]
    if (left, top, fw, fh) == (0, 0, w, h):
        return frame
    h, w = max(h, top + fh), max(w, left + fw)
    out = np.full((h, w, 3), shared[background] if shared is not None and background < len(shared) else 0, np.uint8)
    out[top : top + fh, left : left + fw] = frame
    return out


def decode_bmp(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of an uncompressed bitmap, or one of bit fields."""
    try:
        start, size = struct.unpack("<II", raw[10:18])
        if size == 12:
            w, h, _, bits = struct.unpack("<HHHH", raw[18:26])
            packing, used, entry = 0, 0, 3
        else:
            w, h, _, bits, packing = struct.unpack("<iiHHI", raw[18:34])
            used, entry = struct.unpack("<I", raw[46:50])[0], 4
        down, h = h < 0, abs(h)
        if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h:
            raise ValueError("packing")
        line = (w * bits + 31) // 32 * 4
        rows = np.frombuffer(raw[start : start + line * h], np.uint8).reshape(h, line)
        if bits <= 8:
            n = used or 1 << bits
            palette = np.frombuffer(raw[14 + size : 14 + size + entry * n], np.uint8).reshape(n, entry)[:, 2::-1]
            out = palette[unpacked(rows, bits, w)]
        elif bits == 24 or (bits == 32 and packing == 0):
            out = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
        else:
            masks = struct.unpack("<III", raw[54:66]) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
            x = rows.view("<u2" if bits == 16 else "<u4")[:, :w].astype(np.uint64)
            parts = []
            for m in masks:
                shift = (m & -m).bit_length() - 1
                parts.append(((x & m) >> shift) * 255 // max(1, m >> shift))
            out = np.stack(parts, axis=2)
    except (struct.error, IndexError, ValueError) as error:
        raise ValueError(f"cannot identify image file: {error}") from error
    return np.ascontiguousarray(out if down else out[::-1]).astype(np.uint8)


def decode_anymap(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of P1 to P6."""
    kind, at, numbers = int(raw[1:2]), 2, []
    try:
        while len(numbers) < (2 if kind in (1, 4) else 3):
            found = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
            numbers.append(int(found[1]))
            at = found.end()
        w, h, most = [*numbers, 1][:3]
        n = 3 if kind in (3, 6) else 1
        if not (w and h and 0 < most < 65536):
            raise ValueError("size")
        if kind < 4:
            body = re.sub(rb"#[^\n]*", b"", raw[at:])
            x = np.frombuffer(re.sub(rb"\s", b"", body), np.uint8)[: w * h] - 48 if kind == 1 else np.array(body.split()[: w * h * n], np.int64)
        elif kind == 4:
            line = (w + 7) // 8
            x = unpacked(np.frombuffer(raw[at + 1 : at + 1 + line * h], np.uint8).reshape(h, line), 1, w)
        else:
            x = np.frombuffer(raw, "u1" if most < 256 else ">u2", w * h * n, at + 1)
        x = x.reshape(h, w, n).astype(np.int64)
    except (TypeError, ValueError) as error:
        raise ValueError(f"cannot identify image file: {error}") from error
    x = 255 * (1 - x) if kind in (1, 4) else np.minimum(x, most) * 255 // most
    return np.repeat(x, 3 // n, axis=2).astype(np.uint8)
