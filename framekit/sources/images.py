"""Images as arrays: decoding of PNG files and resizing, in numpy."""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG's colour types: grey, RGB, palette, grey and alpha, RGBA.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(pixels: np.ndarray) -> bytes:
    """An array (height, width) or (height, width, channels) of bytes as a PNG file."""
    a = np.ascontiguousarray(pixels, np.uint8)
    a = a.reshape(*a.shape[:2], -1)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]
    lines = np.concatenate([np.zeros((len(a), 1), np.uint8), a.reshape(len(a), -1)], axis=1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an eight-bit PNG without interlacing; palettes become RGB."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, [], None, None
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        head = part if name == b"IHDR" else head
        palette = np.frombuffer(part, np.uint8).reshape(-1, 3) if name == b"PLTE" else palette
        body += [part] if name == b"IDAT" else []
        at += n + 12
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced:
        raise ValueError("only eight-bit PNG without interlacing")
    step = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int64), above.astype(np.int64), step)
    pixels = out.reshape(height, width, step)
    return palette[pixels[:, :, 0]] if colour == 3 else pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line's bytes from what its filter has left: 0 none, 1 left, 2 above, 3 mean, 4 nearest of left, above and corner."""
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) % 256
    if kind == 1:
        return (np.cumsum(line.reshape(-1, step), axis=0) % 256).reshape(-1)
    out = np.zeros(len(line) + step, np.int64)  # with a pixel of zeros in front
    corner = np.concatenate([np.zeros(step, np.int64), above])
    for i in range(len(line)):
        left, up, c = int(out[i]), int(above[i]), int(corner[i])
        if kind == 3:
            guess = (left + up) // 2
        else:
            away = {0: abs(up - c), 1: abs(left - c), 2: abs(left + up - 2 * c)}
            guess = (left, up, c)[min(away, key=away.get)]
        out[i + step] = (line[i] + guess) % 256
    return out[step:]


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear between pixel centres, rounded; beyond the outer centres, their values."""

    def places(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, old - 1), x - low

    a = pixels.astype(np.float64)
    low, high, part = places(height, a.shape[0])
    a = a[low] * (1 - part)[:, None, None] + a[high] * part[:, None, None]
    low, high, part = places(width, a.shape[1])
    a = a[:, low] * (1 - part)[None, :, None] + a[:, high] * part[None, :, None]
    return np.floor(a + 0.5).astype(np.uint8)


def read_images(spark: SparkSession, path: str, size: tuple[int, int] | None = None) -> DataFrame:
    """path, height, width, channels and pixels (bytes, row by row) of a folder's PNG files, resized to ``size`` (height, width) if given.

    Decoding runs where the files are read, a file at a time. Other formats: ``readers.read_image_files`` and a Python function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = decode_png(content.as_py())
                a = resize(a, *size) if size else a
                yield pa.RecordBatch.from_arrays([pa.array([p]), *[pa.array([n], pa.int32()) for n in a.shape], pa.array([a.tobytes()], pa.binary())], ["path", "height", "width", "channels", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, height int, width int, channels int, pixels binary")
