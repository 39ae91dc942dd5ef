"""Decoded pictures made upright and brought to a working size.

Spark's picture source decodes; what the file says of its orientation is read from its first bytes; arrays in tasks turn the pixels and shrink
them.  A picture that can't be decoded or prepared is a row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqc.functions.filters import resampling_table
from lumenqc.sources import readers

#: Bytes in which the orientation is looked for: one segment of a file may have so many, and it stands near the start.
HEAD = 1 << 17
#: Longest sides that are tried one after the other when memory doesn't suffice.
LADDER = (1600, 1280, 1024)
SCHEMA = "path string, height int, width int, orientation int, r array<double>, g array<double>, b array<double>, error string"


def orientation(head: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's metadata gives; 1 if it gives none or is broken."""
    at = 2
    if head[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            try:
                return tagged(body[6:])
            except struct.error:
                return 1
        at += 2 + size
    return 1


def tagged(block: bytes) -> int:
    """The orientation tag of the first directory of a metadata block."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None:
        return 1
    (first,) = struct.unpack_from(f"{order}I", block, 4)
    (count,) = struct.unpack_from(f"{order}H", block, first)
    for k in range(count):
        tag, kind, _, value = struct.unpack_from(f"{order}HHIH", block, first + 2 + 12 * k)
        if tag == 0x0112 and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def upright(image: np.ndarray, how: int) -> np.ndarray:
    """The picture (rows, columns, channels) as it is to be seen."""
    turned = {
        2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1),
        6: lambda x: x[::-1].swapaxes(0, 1), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: lambda x: x[:, ::-1].swapaxes(0, 1),
    }
    return turned.get(how, lambda x: x)(image)


def shrunk(image: np.ndarray, most: int) -> np.ndarray:
    """The picture with its longer side brought down to ``most`` by a triangle kernel; a smaller one stays."""
    height, width = image.shape[:2]
    if max(height, width) <= most:
        return image
    scale = most / max(height, width)
    out = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        to = max(1, int(size * scale))
        made = np.empty((to, *np.moveaxis(out, axis, 0).shape[1:]))
        lines = np.moveaxis(out, axis, 0)
        for k, (first, taps) in enumerate(resampling_table(size, to, "bilinear")):
            made[k] = np.tensordot(taps, lines[first : first + len(taps)], axes=1)
        out = np.moveaxis(made, 0, axis)
    return out


def prepared(data: bytes, height: int, width: int, channels: int, how: int, ladder: tuple[int, ...]) -> np.ndarray:
    """Red, green and blue by row and column, upright, at the first size for which memory suffices."""
    for k, most in enumerate(ladder):
        try:
            image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            image = np.repeat(image, 3, 2) if channels == 1 else image[..., 2::-1]  # blue, green and red are stored in this order
            return shrunk(upright(image, how), most)
        except MemoryError:
            if k + 1 == len(ladder):
                raise
    raise ValueError("no size to try")


def decoded(spark: SparkSession, folder: str, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(path, height, width, orientation, r, g, b, error): channels as arrays, row after row; ``error`` says why a picture has none."""
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(readers.is_picture())
    heads = files.select(plain("path").alias("path"), F.substring("content", 1, HEAD).alias("head"))
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*")
    images = images.select(plain("origin").alias("path"), "height", "width", "nChannels", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                how, image, error = orientation(row["head"] or b""), None, None
                try:
                    if not row["data"] or min(row["height"], row["width"]) <= 0:
                        raise ValueError("the picture can't be decoded")
                    image = prepared(row["data"], row["height"], row["width"], row["nChannels"], how, ladder)
                except (ValueError, MemoryError) as e:
                    error = f"{type(e).__name__}: {e}"
                channels = [None] * 3 if image is None else [image[..., k].ravel().astype(float).tolist() for k in range(3)]
                values = [row["path"], *(image.shape[:2] if image is not None else (None, None)), how, *channels, error]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES, strict=True)], NAMES)

    return heads.join(images, "path", "left").mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
