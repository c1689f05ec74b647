"""JPEG files, sequential and progressive, of Huffman codes.

Codes are found by tables over all bit positions, made at once; what is left to do one by one is a walk from
code to code. Values, prediction, the inverse cosine transform, chroma upsampling and colours are array
operations over all blocks.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# The order in which coefficients of a block are written.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
MARKER = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])", re.S)
#: Bytes whose bit positions are looked at together; more that a unit's codes may run into.
CHUNK, MARGIN = 1 << 16, 4096
#: Steps of no code.
NO_CODE = 255


class Codes:
    """A Huffman table: length and symbol for every 16 bits that may follow."""

    def __init__(self, counts: bytes, symbols: bytes):
        lengths = np.repeat(np.arange(1, 17), np.frombuffer(counts, np.uint8))
        share = 1 << (16 - lengths)
        if share.sum() > 1 << 16 or len(symbols) < len(lengths):
            raise ValueError("Huffman table")
        rest = (1 << 16) - int(share.sum())
        self.length = np.concatenate([np.repeat(lengths, share), np.zeros(rest, int)]).astype(np.uint8)
        self.symbol = np.concatenate([np.repeat(np.frombuffer(symbols, np.uint8)[: len(lengths)], share), np.zeros(rest, np.uint8)])


class Bits:
    """The coded bytes of a scan, restart intervals one after the other."""

    def __init__(self, data: bytes):
        parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff+[\xd0-\xd7]", data)]
        self.starts = np.cumsum([0, *[8 * len(p) for p in parts]]).tolist()
        self.bytes = np.frombuffer(b"".join(parts) + bytes(2 * MARGIN), np.uint8)
        self.end = self.starts[-1]

    def ahead(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n bits (16 at most) from each position."""
        i = np.minimum(at >> 3, len(self.bytes) - 4)
        b = self.bytes
        four = (b[i].astype(np.int64) << 24) | (b[i + 1].astype(np.int64) << 16) | (b[i + 2].astype(np.int64) << 8) | b[i + 3]
        return (four >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def chunk(self, first: int) -> np.ndarray:
        """The 16 bits from every position of a chunk and its margin."""
        b = self.bytes[first : first + CHUNK + MARGIN + 2].astype(np.uint32)
        three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        return ((three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).ravel()


def extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((value << 1) >> size == 0, value - (1 << size) + 1, value)


class Component:
    def __init__(self, name: int, h: int, v: int, table: int):
        self.name, self.h, self.v, self.table = name, h, v, table


class Jpeg:
    def __init__(self, raw: bytes):
        self.raw, self.tables, self.codes, self.restart = raw, {}, {}, 0
        self.parts: list[Component] = []
        self.adobe, self.jfif = None, False
        at, scans = 2, 0
        while True:
            found = MARKER.search(raw, at)
            if not found:
                raise ValueError("image file is truncated")
            kind, at = raw[found.end()], found.end() + 1
            if kind == 0xD9:
                break
            if kind in (0x01, 0xD8):
                continue
            body = raw[at + 2 : at + struct.unpack(">H", raw[at : at + 2])[0]]
            at += 2 + len(body)
            if kind == 0xDB:
                self.quantities(body)
            elif kind == 0xC4:
                self.huffman(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self.frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("kind of JPEG")
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xE0 and body[:4] == b"JFIF":
                self.jfif = True
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
                self.adobe = body[11]
            elif kind == 0xDA:
                stop = MARKER.search(raw, at)
                self.scan(body, raw[at : stop.start() if stop else len(raw)])
                at = stop.start() if stop else len(raw)
                scans += 1
        if not scans:
            raise ValueError("no scan")

    def quantities(self, body: bytes) -> None:
        while body:
            wide, name = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.tables[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.float32)
            if len(self.tables[name]) != 64:
                raise ValueError("quantities")
            body = body[1 + n :]

    def huffman(self, body: bytes) -> None:
        while len(body) > 16:
            n = sum(body[1:17])
            self.codes[body[0]] = Codes(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def frame(self, body: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if self.parts or bits != 8 or not self.height or not self.width or n not in (1, 3, 4):
            raise ValueError("frame")
        self.progressive = progressive
        self.parts = [Component(*[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]]) for i in range(n)]
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        if not all(1 <= p.h <= 4 and 1 <= p.v <= 4 for p in self.parts):
            raise ValueError("sampling")
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts:
            p.width, p.height = -(-self.width * p.h // self.h), -(-self.height * p.v // self.v)
            p.stride, p.rows = self.across * p.h, self.down * p.v
            p.coefficients = np.zeros((p.rows * p.stride, 64), np.int32)

    def scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = []
        for i in range(n):
            part = next((p for p in self.parts if p.name == body[1 + 2 * i]), None)
            if part is None:
                raise ValueError("scan")
            chosen.append((part, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        bits = Bits(data)
        # the blocks of a unit: component, its tables, and the places of its blocks by unit
        if n == 1:
            part = chosen[0][0]
            w, h = -(-part.width // 8), -(-part.height // 8)
            units = w * h
            unit = [(chosen[0], (np.arange(h)[:, None] * part.stride + np.arange(w)).ravel())]
        else:
            units = self.across * self.down
            y, x = np.divmod(np.arange(units), self.across)
            unit = [(c, (y * c[0].v + v) * c[0].stride + x * c[0].h + h) for c in chosen for v in range(c[0].v) for h in range(c[0].h)]
        each = self.restart or units
        spans = [(bits.starts[k], min(each, units - k * each)) for k in range(-(-units // each))] if len(bits.starts) > -(-units // each) else None
        if spans is None:
            raise ValueError("image file is truncated")
        if not self.progressive:
            self.walk(bits, spans, unit, True, 0)
        elif first == 0 and not high:
            self.walk(bits, spans, unit, False, low)
        elif first == 0:
            self.refine_means(bits, spans, unit, low)
        elif n == 1:
            (part, _, table), places = unit[0]
            self.spectrum(bits, spans, part, self.codes[16 + table], places, first, last, high, low)
        else:
            raise ValueError("scan")

    def walk(self, bits: Bits, spans: list, unit: list, whole: bool, low: int) -> None:
        """Blocks with their means (DC), and all else if ``whole``; the positions of codes, means as ``~position``."""
        found, out, base = [], [], -1
        steps: list = []

        def load(first: int) -> None:
            """Tables of steps for every bit position from byte ``first``."""
            nonlocal base, steps
            ahead, made, base = bits.chunk(first), {}, first * 8
            for (_, dc, ac), _ in unit:
                for name in (dc, 16 + ac) if whole else (dc,):
                    if name not in made:
                        codes = self.codes[name]
                        length, symbol = codes.length[ahead], codes.symbol[ahead]
                        size = symbol & 15
                        made[name] = (length + size).astype(np.uint8).tobytes(), np.where(symbol == 0, 64, np.where(length == 0, 64, (symbol >> 4) + 1)).astype(np.uint8).tobytes() if name > 15 else b""
            steps = [(made[dc][0], *(made[16 + ac] if whole else (b"", b""))) for (_, dc, ac), _ in unit]

        for start, count in spans:
            p = start - base
            for _ in range(count):
                if base < 0 or p >= CHUNK * 8:
                    p += base
                    out.append((np.array(found, np.int64), base))
                    found = []
                    if p > bits.end:
                        raise ValueError("image file is truncated")
                    load(p >> 3)
                    p -= base
                for mean, step, skip in steps:
                    found.append(~p)
                    p += mean[p]
                    if whole:
                        k = 1
                        while k < 64:
                            found.append(p)
                            k += skip[p]
                            p += step[p]
            if p + base > bits.end:
                raise ValueError("image file is truncated")
        out.append((np.array(found, np.int64), base))
        flat = np.concatenate([np.where(x < 0, x - b, x + b) for x, b in out])
        is_mean = flat < 0
        at = np.where(is_mean, ~flat, flat)
        block = np.cumsum(is_mean) - 1
        slot = block % len(unit)
        segment = np.repeat(np.arange(len(spans)), [n for _, n in spans])
        ahead = bits.ahead(at, 16)
        for s, ((part, dc, ac), places) in enumerate(unit):
            mine = slot == s
            for own, name in ((mine & is_mean, dc), (mine & ~is_mean, 16 + ac)):
                if not own.any():
                    continue
                codes, here = self.codes[name], np.flatnonzero(own)
                length, symbol = codes.length[ahead[here]].astype(np.int64), codes.symbol[ahead[here]].astype(np.int64)
                if (length == 0).any():
                    raise ValueError("code")
                size = symbol & 15
                value = extended(bits.ahead(at[here] + length, size), size) * (size > 0)
                if name < 16:
                    part.coefficients[places, 0] = value << low  # still differences
                else:
                    step = np.where(symbol == 0, 0, (symbol >> 4) + 1)
                    total = np.cumsum(step)
                    unit_of = block[here] // len(unit)
                    new = np.flatnonzero(np.diff(unit_of, prepend=-1))
                    k = total - np.repeat((total - step)[new], np.diff([*new, len(here)]))
                    keep = size > 0
                    if (k[keep] > 63).any():
                        raise ValueError("code")
                    part.coefficients[places[unit_of[keep]], k[keep]] = value[keep]
        for part in dict.fromkeys(c[0] for c, _ in unit):
            # means are differences along the units, anew in each restart interval
            order = np.stack([places for c, places in unit if c[0] is part], axis=1)
            run = np.cumsum(part.coefficients[order.ravel(), 0]).reshape(order.shape)
            first = np.flatnonzero(np.diff(segment, prepend=-1))
            before = np.concatenate([[0], run[first[1:] - 1, -1]])
            part.coefficients[order.ravel(), 0] = (run - before[segment][:, None]).ravel()

    def refine_means(self, bits: Bits, spans: list, unit: list, low: int) -> None:
        unit_at = np.concatenate([start + len(unit) * np.arange(n) for start, n in spans])
        for s, ((part, *_), places) in enumerate(unit):
            part.coefficients[places, 0] |= (bits.ahead(unit_at + s, 1) << low).astype(np.int32)

    def spectrum(self, bits: Bits, spans: list, part: Component, codes: Codes, places: np.ndarray, first: int, last: int, high: int, low: int) -> None:
        """One component's coefficients from first to last, new (high is 0) or one bit finer."""
        b, length, symbol = bits.bytes.tobytes(), codes.length.tobytes(), codes.symbol.tobytes()
        flat = part.coefficients
        done = 0

        def peek(p: int, n: int) -> int:
            i = p >> 3
            return (int.from_bytes(b[i : i + 4], "big") >> (32 - (p & 7) - n)) & ((1 << n) - 1)

        for p, count in spans:
            left = 0  # blocks that are at their end already
            for place in places[done : done + count].tolist():
                if p > bits.end:
                    raise ValueError("image file is truncated")
                k = first
                row = flat[place].tolist() if high else None
                changed = {}
                while k <= last and not left:
                    code = peek(p, 16)
                    if not length[code]:
                        raise ValueError("code")
                    p += length[code]
                    run, size = symbol[code] >> 4, symbol[code] & 15
                    value = 0
                    if size:
                        value = peek(p, size)
                        value = (value if value >> (size - 1) else value - (1 << size) + 1) << low
                        p += size
                    elif run < 15:
                        left = (1 << run) + (peek(p, run) if run else 0)
                        p += run
                        break
                    if not high:
                        k += run
                        if value and k < 64:
                            changed[k] = value
                        k += 1
                        continue
                    while k <= last:  # known ones take a bit each on the way
                        if row[k]:
                            if peek(p, 1) and not row[k] & (1 << low) if row[k] > 0 else peek(p, 1) and not -row[k] & (1 << low):
                                changed[k] = row[k] + ((1 << low) if row[k] > 0 else -(1 << low))
                            p += 1
                        elif run:
                            run -= 1
                        else:
                            if value:
                                changed[k] = value
                            k += 1
                            break
                        k += 1
                if left:
                    if high:
                        for j in range(k, last + 1):
                            if row[j]:
                                if peek(p, 1) and not abs(row[j]) & (1 << low):
                                    changed[j] = row[j] + ((1 << low) if row[j] > 0 else -(1 << low))
                                p += 1
                    left -= 1
                for j, v in changed.items():
                    flat[place, j] = v
            done += count

    def plane(self, part: Component) -> np.ndarray:
        """The component's samples at its own resolution."""
        x = np.arange(8)
        wave = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
        wave = wave.astype(np.float32)
        out = np.empty((part.rows * 8, part.stride * 8), np.uint8)
        order = np.argsort(ZIGZAG)
        for lo in range(0, part.rows, 32):
            blocks = part.coefficients[lo * part.stride : (lo + 32) * part.stride] * self.tables[part.table]
            blocks = (blocks[:, order].reshape(-1, 8) @ wave).reshape(-1, 8, 8)
            blocks = (blocks.transpose(0, 2, 1).reshape(-1, 8) @ wave).reshape(-1, part.stride, 8, 8)
            some = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8)  # rows of blocks, blocks, x, y
            out[lo * 8 : lo * 8 + len(some) * 8] = some.transpose(0, 3, 1, 2).reshape(len(some) * 8, -1)
        return out[: part.height, : part.width]

    def full(self, part: Component) -> np.ndarray:
        """The component's samples at the image's resolution; halves are filled in with a triangle's weights."""
        x, across, down = self.plane(part), self.h // part.h, self.v // part.v
        if (across, down) == (2, 2) and x.shape[1] > 2:
            y = x.astype(np.int32)
            above, under = np.vstack([y[:1], y[:-1]]), np.vstack([y[1:], y[-1:]])
            sums = np.stack([3 * y + above, 3 * y + under], axis=1).reshape(-1, y.shape[1])
            left, right = np.hstack([sums[:, :1], sums[:, :-1]]), np.hstack([sums[:, 1:], sums[:, -1:]])
            x = np.stack([(3 * sums + left + 8) >> 4, (3 * sums + right + 7) >> 4], axis=2).reshape(len(sums), -1).astype(np.uint8)
        elif (across, down) == (2, 1) and x.shape[1] > 2:
            y = x.astype(np.int32)
            left, right = np.hstack([y[:, :1], y[:, :-1]]), np.hstack([y[:, 1:], y[:, -1:]])
            x = np.stack([(3 * y + left + 1) >> 2, (3 * y + right + 2) >> 2], axis=2).reshape(len(y), -1).astype(np.uint8)
        elif across > 1 or down > 1:
            x = np.repeat(np.repeat(x, down, axis=0), across, axis=1)
        return x[: self.height, : self.width]

    def pixels(self) -> np.ndarray:
        planes = [self.full(p) for p in self.parts]
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        named = [p.name for p in self.parts]
        mixed = self.adobe != 0 if self.adobe is not None else self.jfif or named != [ord(c) for c in "RGB"]
        if len(planes) == 4:
            mixed = self.adobe == 2
        out = np.empty((self.height, self.width, 3), np.uint8)
        for lo in range(0, self.height, 256):
            a, b, c = (x[lo : lo + 256].astype(np.float32) for x in planes[:3])
            if mixed:
                b, c = b - 128, c - 128
                rgb = np.stack([a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b], axis=2)
            else:
                rgb = np.stack([a, b, c], axis=2)
            rgb = np.clip(np.rint(rgb), 0, 255)
            if len(planes) == 4:
                # inks, written from white to full
                black = planes[3][lo : lo + 256, :, None].astype(np.float32)
                rgb = np.rint(rgb * black / 255) if self.adobe is not None else np.rint((255 - rgb) * (255 - black) / 255)
            out[lo : lo + 256] = rgb
        return out


def decode_jpeg(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes."""
    try:
        return Jpeg(raw).pixels()
    except (struct.error, IndexError, KeyError, AttributeError, ValueError) as error:
        raise ValueError(f"cannot identify image file: {error}") from error
