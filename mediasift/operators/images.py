"""Images to encoder input: pixel cap, quarantine, decoding, bicubic resize, crop, normalise, encode."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.codecs import decode_image
from mediasift.functions.media import MEAN, SIDE, STD, bomb_pixels, megapixels, within_cap
from mediasift.sources.content import content_of


def pixel_cap(images: DataFrame, cap: int | None) -> DataFrame:
    return images.where(within_cap(F.col("width"), F.col("height"), cap))


def skip_reason(error: Column, width: Column, height: Column, cap: int | None) -> Column:
    """Why an image is left out (null: it is not): too_large, bomb, out_of_memory, unreadable or other."""
    return (
        F.when(~within_cap(width, height, cap), "too_large")
        .when(bomb_pixels(error) > 0, "bomb")
        .when(error.startswith("out of memory"), "out_of_memory")
        .when((width < 0) | error.startswith("cannot identify"), "unreadable")
        .when(error.isNotNull(), "other")
    )


def skip_message(reason: Column, error: Column, width: Column, height: Column) -> Column:
    size = F.when(reason == "bomb", bomb_pixels(error)).otherwise(width * height)
    return F.when(reason.isin("too_large", "bomb"), F.concat(megapixels(size), F.lit(" MP is above the cap"))).otherwise(F.coalesce(error, F.lit("cannot be read")))


def quarantine(images: DataFrame, cap: int | None) -> DataFrame:
    """Images with ``reason`` and ``message``; good ones have a null reason. Split with a filter."""
    out = images.withColumn("reason", skip_reason(F.col("error"), F.col("width"), F.col("height"), cap))
    return out.withColumn("message", F.when(F.col("reason").isNotNull(), skip_message(F.col("reason"), F.col("error"), F.col("width"), F.col("height"))))


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * a - 4 * a, 0.0))


def resample_matrix(size: int, target: int) -> np.ndarray:
    """Antialiased bicubic weights, rows of ``target`` over columns of ``size``."""
    scale = max(size / target, 1.0)
    centre = (np.arange(target) + 0.5) * size / target
    weight = cubic((np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale)
    return weight / weight.sum(axis=1, keepdims=True)


def preprocess(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Height x width x 3 bytes to 3 x side x side normalised floats."""
    h, w = rgb.shape[:2]
    new_w, new_h = (side, int(h * side / w)) if w < h else (int(w * side / h), side)
    x = rgb.astype(np.float64)
    if (h, w) != (new_h, new_w):
        # eight-bit results after each pass, as image libraries give
        x = np.clip(np.floor(np.einsum("ij,hjc->hic", resample_matrix(w, new_w), x) + 0.5), 0, 255)
        x = np.clip(np.floor(np.einsum("ij,jwc->iwc", resample_matrix(h, new_h), x) + 0.5), 0, 255)
    left, top = round((new_w - side) / 2.0), round((new_h - side) / 2.0)
    x = x[top : top + side, left : left + side].astype(np.float32) / np.float32(255)
    return ((x - np.array(MEAN, np.float32)) / np.array(STD, np.float32)).transpose(2, 0, 1)


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or JPEG from its head; nothing is decoded."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return abs(w), abs(h)
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 <= len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def load_image(raw: bytes, decode: Callable[[bytes], np.ndarray], cap: int | None, side: int = SIDE) -> np.ndarray:
    """Encoder input of an image; one above the cap is refused by its head, before it is decoded."""
    size = image_size(raw)
    if cap is not None and size and size[0] * size[1] > cap:
        raise ValueError(f"Image size ({size[0] * size[1]} pixels) exceeds the cap")
    rgb = decode(raw)
    if cap is not None and rgb.shape[0] * rgb.shape[1] > cap:
        raise ValueError(f"Image size ({rgb.shape[0] * rgb.shape[1]} pixels) exceeds the cap")
    return preprocess(rgb, side)


def encode_images(rows: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], *, decode: Callable[[bytes], np.ndarray] = decode_image, cap: int | None = None, batch: int = 8, read: Callable[[str], bytes] = content_of) -> DataFrame:
    """Rows of a listing with the unit ``vector`` of each image, or a null one, a ``reason`` and a ``message``.

    Tasks open the files, refuse what is above the cap, decode, resize, and encode ``batch`` images at once with an
    encoder built once a task. An image that fails fails alone; if the encoder fails, its batch does."""
    if batch < 1:
        raise ValueError("batch must be at least 1")
    place = rows.columns.index("filepath")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                errors: list[str | None] = [None] * part.num_rows
                images, own = [], []
                for k, path in enumerate(part.column(place).to_pylist()):
                    try:
                        images.append(load_image(read(path), decode, cap))
                        own.append(k)
                    except MemoryError:
                        errors[k] = "out of memory while decoding"
                    except Exception as error:  # decoders raise what they like; the file is reported and left out
                        errors[k] = str(error) or type(error).__name__
                vectors: list = [None] * part.num_rows
                if images:
                    try:
                        encode = encode or make_encoder()
                        found = np.asarray(encode(np.stack(images)), np.float32)
                        for k, v, n in zip(own, found, np.linalg.norm(found, axis=-1), strict=True):
                            if n > 0 and np.isfinite(n):
                                vectors[k] = v / n
                            else:
                                errors[k] = "the encoder gave a vector without a direction"
                    except Exception as error:
                        for k in own:
                            errors[k] = f"the encoder failed: {error}"
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*part.schema.names, "vector", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    found = rows.mapInArrow(run, f"{fields}, vector array<float>, error string")
    above = F.col("error").endswith("exceeds the cap")
    none = F.lit(None).cast("long")
    reason = F.when(above, "too_large").otherwise(skip_reason(F.col("error"), none, none, None))
    message = F.when(above, F.concat(megapixels(bomb_pixels(F.col("error"))), F.lit(" MP is above the cap"))).otherwise(skip_message(reason, F.col("error"), none, none))
    return found.withColumn("reason", F.when(F.col("error").isNotNull(), reason)).withColumn("message", F.when(F.col("error").isNotNull(), message)).drop("error")
