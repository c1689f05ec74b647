"""Image files against the JVM's own reader and writer, and files put together by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift import codecs
from mediasift.operators import images as im
from mediasift.plans.media_index import MediaIndex


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_file(w, h, depth, kind, lines, interlaced=0, palette=b""):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def photo(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = np.stack([128 + 100 * np.sin(x / 37 + y / 91), 128 + 100 * np.cos(x / 53 - y / 29), 128 + 90 * np.sin((x + y) / 71)], axis=2)
    base[h // 3 : h // 2, w // 4 : w // 2] = [250, 20, 30]
    return np.clip(base + rng.normal(size=(h, w, 3)) * 8, 0, 255).astype(np.uint8)


class Jvm:
    """The JVM's image reader and writers."""

    def __init__(self, spark, folder):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.io, self.file = self.jvm.javax.imageio.ImageIO, self.jvm.java.io.File

    def write(self, pixels, name, progressive=False, quality=None):
        h, w = pixels.shape[:2]
        source, target = self.folder / "source.png", self.folder / name
        source.write_bytes(png_file(w, h, 8, 2 if pixels.ndim == 3 else 0, b"".join(b"\0" + r.tobytes() for r in pixels)))
        writer = self.io.getImageWritersByFormatName(name.rsplit(".", 1)[-1]).next()
        how = writer.getDefaultWriteParam()
        if progressive:
            how.setProgressiveMode(1)
        if quality:
            how.setCompressionMode(2)
            how.setCompressionQuality(quality)
        target.unlink(missing_ok=True)
        stream = self.io.createImageOutputStream(self.file(str(target)))
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(self.io.read(self.file(str(source))), None, None), how)
        stream.close()
        return target.read_bytes()

    def read(self, name):
        again = self.folder / "again.png"
        self.io.write(self.io.read(self.file(str(self.folder / name))), "png", self.file(str(again)))
        return codecs.decode_png(again.read_bytes())


@pytest.fixture
def jvm(spark, tmp_path):
    return Jvm(spark, tmp_path)


@pytest.mark.parametrize("size", [(64, 64), (61, 47), (9, 8), (1, 1), (130, 201), (16, 17)])
@pytest.mark.parametrize("how", [{}, {"quality": 0.98}, {"progressive": True}, {"progressive": True, "quality": 0.3}])
def test_jpeg(jvm, size, how):
    x = photo(*size)
    for pixels in (x, x[:, :, 0]):
        raw = jvm.write(pixels, "a.jpg", **how)
        got, want = codecs.decode_image(raw).astype(int), jvm.read("a.jpg").astype(int)
        assert got.shape == want.shape and abs(got - want).max() <= 3 and abs(got - want).mean() < 1
        assert im.image_size(raw) == size[::-1]


def test_jpeg_over_many_chunks_and_restarts(jvm, monkeypatch):
    from mediasift.codecs import jpeg

    raw = jvm.write(photo(200, 300), "a.jpg", quality=0.95)
    want = codecs.decode_image(raw)
    monkeypatch.setattr(jpeg, "CHUNK", 64)
    assert (codecs.decode_image(raw) == want).all()
    # restart intervals, written by hand: a grey image of four blocks whose means are 1, 2, 3, 4 steps above the middle
    tables = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64) + b"\xff\xc4" + struct.pack(">HB", 20 + 1, 0) + bytes([0, 2] + [0] * 14) + bytes([2, 3]) + b"\xff\xc4" + struct.pack(">HB", 20, 16) + bytes([1] + [0] * 15) + bytes([0])
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8, 32, 1) + bytes([1, 0x11, 0]) + b"\xff\xdd" + struct.pack(">HH", 4, 2) + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])
    code = lambda size, value: ("00" if size == 2 else "01") + format(value, f"0{size}b") + "0"
    interval = lambda bits: bytes(int(bits.ljust(16, "1")[i : i + 8], 2) for i in (0, 8))
    data = interval(code(2, 2) + code(2, 2)) + b"\xff\xd0" + interval(code(3, 6) + code(2, 3))
    got = codecs.decode_image(b"\xff\xd8" + tables + frame + data + b"\xff\xd9")
    assert [int(got[0, 8 * k, 0]) - 128 for k in range(4)] == [2, 4, 6, 9]


def test_damaged_jpeg(jvm):
    raw = jvm.write(photo(80, 90), "a.jpg")
    slow = jvm.write(photo(80, 90), "b.jpg", progressive=True)
    for whole in (raw, slow):
        for cut in (2, 30, 200, len(whole) // 2, len(whole) - 2):
            with pytest.raises(ValueError):
                codecs.decode_image(whole[:cut])
    rng = np.random.default_rng(1)
    for _ in range(150):  # whatever the damage, pixels or a ValueError
        bad = bytearray(slow if rng.integers(2) else raw)
        for at in rng.integers(2, len(bad), 3):
            bad[at] = rng.integers(256)
        try:
            assert codecs.decode_image(bytes(bad)).ndim == 3
        except ValueError:
            pass


def test_gif_and_bmp(jvm):
    x = photo(70, 90)
    jvm.write(x, "a.gif")
    raw = (jvm.folder / "a.gif").read_bytes()
    assert (codecs.decode_image(raw) == jvm.read("a.gif")).all()
    assert (codecs.decode_image(jvm.write(x, "a.bmp")) == x).all() and im.image_size(raw) == (90, 70)
    # sixteen bits of fields, rows from the top; a palette of four bits, rows from the bottom
    fields = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 70) + struct.pack("<IiiHHIIiiII", 56, 2, -1, 1, 16, 3, 0, 0, 0, 0, 0) + struct.pack("<IIII", 0xF800, 0x7E0, 0x1F, 0) + struct.pack("<HH", 0xF800, 0x7E0)
    assert codecs.decode_image(fields).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    few = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 4, 0, 0, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + b"\x01\x00\0\0" + b"\x11\x10\0\0"
    assert codecs.decode_image(few).tolist() == [[[7, 8, 9]] * 3, [[3, 2, 1], [7, 8, 9], [3, 2, 1]]]
    for bad in (raw[:50], raw[: len(raw) // 2], fields[:40], few[:66], b"GIF89a", b"BM", b"", b"RIFF....WEBP"):
        with pytest.raises(ValueError):
            codecs.decode_image(bad)


def test_anymaps():
    x = np.arange(12).reshape(2, 2, 3) * 20
    assert (codecs.decode_image(b"P6\n# a remark\n2 2\n255\n" + x.astype(np.uint8).tobytes()) == x).all()
    assert (codecs.decode_image(b"P3 2 2 255\n" + " ".join(map(str, x.ravel())).encode()) == x).all()
    assert codecs.decode_image(b"P5 2 1 65535\n" + struct.pack(">HH", 65535, 0))[0, :, 0].tolist() == [255, 0]
    assert codecs.decode_image(b"P4 3 1\n" + bytes([0b10100000]))[0, :, 0].tolist() == [0, 255, 0]
    assert codecs.decode_image(b"P1 3 1\n101")[0, :, 0].tolist() == [0, 255, 0] and codecs.decode_image(b"P2 1 1 4 2")[0, 0, 0] == 127
    for bad in (b"P6 2 2 255\nabc", b"P6 2", b"P2 1 1 0 2", b"P7 1 1"):
        with pytest.raises(ValueError):
            codecs.decode_image(bad)


def filtered(x, n):
    """Rows of bytes with the five filters in turn, n bytes a pixel."""
    h = len(x)
    x, out = x.reshape(h, -1, n).astype(int), []
    for y in range(h):
        left = np.vstack([np.zeros((1, n), int), x[y, :-1]])
        up = x[y - 1] if y else np.zeros_like(x[y])
        corner = np.vstack([np.zeros((1, n), int), up[:-1]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        out.append(bytes([y % 5]) + ((x[y] - (0, left, up, (left + up) >> 1, paeth)[y % 5]) & 255).astype(np.uint8).tobytes())
    return b"".join(out)


@pytest.mark.parametrize("band", [3, 512])
def test_png_depths_and_passes(monkeypatch, band):
    from mediasift.codecs import png

    monkeypatch.setattr(png, "BAND", band)
    rng = np.random.default_rng(2)
    for w, h in ((1, 1), (5, 7), (13, 9), (3, 20), (2, 1)):
        for kind, n in png.CHANNELS.items():
            for depth in (1, 2, 4, 8, 16) if kind == 0 else (1, 2, 4, 8) if kind == 3 else (8, 16):
                x = rng.integers(0, 1 << depth, (h, w, n))
                palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
                want = palette[x[:, :, 0]] if kind == 3 else x * 255 // ((1 << depth) - 1) if depth < 8 else x >> (depth - 8)
                want = want if kind == 3 else np.repeat(want[:, :, :1], 3, axis=2) if n < 3 else want[:, :, :3]

                def packed(part):
                    if depth == 16:
                        return part.astype(">u2").view(np.uint8).reshape(len(part), -1)
                    bits = np.unpackbits(part.astype(np.uint8)[..., None], axis=-1)[..., 8 - depth :].reshape(len(part), -1)
                    return np.packbits(bits, axis=1)

                size = max(1, n * depth // 8)
                plain = png_file(w, h, depth, kind, filtered(packed(x), size), 0, palette.tobytes() if kind == 3 else b"")
                assert (codecs.decode_image(plain) == want).all()
                parts = [x[b::d, a::c] for a, b, c, d in png.PASSES]
                lines = b"".join(filtered(packed(p), size) for p in parts if p.size)
                assert (codecs.decode_image(png_file(w, h, depth, kind, lines, 1, palette.tobytes() if kind == 3 else b"")) == want).all()


def test_large_png_is_fast():
    import time

    x = np.random.default_rng(3).integers(0, 256, (3024, 4032, 3)).astype(np.uint8)
    raw = png_file(4032, 3024, 8, 2, b"".join(b"\x04" + r.tobytes() for r in x))
    began = time.process_time()
    got = codecs.decode_image(raw)
    assert got.shape == x.shape and time.process_time() - began < 20


def test_library_of_common_formats(spark, jvm, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    writer = Jvm(spark, lib)
    colours = {"red.jpg": (250, 10, 10), "slow.jpg": (200, 40, 10), "green.gif": (10, 250, 10), "blue.bmp": (10, 10, 250)}
    for name, colour in colours.items():
        writer.write(np.full((40, 60, 3), colour, np.uint8), name, progressive=name == "slow.jpg")
    (lib / "source.png").unlink()
    (lib / "grey.pgm").write_bytes(b"P5 20 20 255\n" + bytes([128]) * 400)
    (lib / "black.ppm").write_bytes(b"P6 20 20 255\n" + bytes(1200))
    (lib / "broken.jpeg").write_bytes((lib / "red.jpg").read_bytes()[:300])

    def make():
        from mediasift.functions.media import MEAN, STD

        return lambda x: np.rint(20 * (x.mean(axis=(2, 3)) * np.array(STD) + np.array(MEAN)))

    words = {"red": [1.0, 0.0, 0.0], "green": [0.0, 1.0, 0.0], "blue": [0.0, 0.0, 1.0]}
    index = MediaIndex(spark, f"file://{tmp_path}/index", make, lambda q: words[q])
    skipped = {r["filepath"].rsplit("/", 1)[-1]: (r["reason"], r["message"]) for r in index.refresh(str(lib)).collect()}
    assert set(skipped) == {"broken.jpeg", "black.ppm"} and skipped["broken.jpeg"][0] == "unreadable" and "direction" in skipped["black.ppm"][1]
    first = lambda q: index.search(str(lib), q, refresh=False).first()["filepath"].rsplit("/", 1)[-1]
    assert (first("red"), first("green"), first("blue")) == ("red.jpg", "green.gif", "blue.bmp")
    assert index.store.read().where(F.exists("vector", F.isnan)).count() == 0
